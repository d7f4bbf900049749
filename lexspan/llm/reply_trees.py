"""Chat formatting of reply trees.

Messages name their parent.  Iterative self-joins double, round by round, how
far each message sees up its branch, and let every leaf collect the messages
above it, so a thread of depth d takes log2(d) rounds, not d.  Only ids and
scores travel.  The paths from root to leaf are ranked in each conversation, and
texts meet the places that they take in the chosen paths once, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import ready_to_checkpoint

#: Paths of a tree that are formatted; None: all.
TOP = None


def with_parents(messages: DataFrame) -> DataFrame:
    """Parents for a table of turns (conv_id, turn, role, text): a message
    answers the turn before it.  Where several messages share a turn they are
    alternatives, and the next turn answers the longest (of equally long ones
    the one of the least role and text).  Repeated rows are one message; rows of
    a null conv_id or turn are left out, as nothing can answer them; a null text is a message of
    score 0; texts are kept whole; an empty table gives an empty result.
    Result: conv_id, msg_id, parent_id, role, text, score (the text's characters).
    Everything happens within conversations, so the texts move once."""
    base = messages.select("conv_id", "turn", "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("score")).where("conv_id IS NOT NULL AND turn IS NOT NULL").repartition("conv_id").distinct()
    key = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    base = base.withColumn("alt", F.row_number().over(key) - 1)
    turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    parent = F.max("turn").over(turns)
    ident = lambda turn, alt: F.concat(turn.cast("string"), F.lit("."), alt.cast("string"))
    return base.select("conv_id", ident(F.col("turn"), F.col("alt")).alias("msg_id"), F.when(parent.isNotNull(), ident(parent, F.lit(0))).alias("parent_id"), "role", "text", "score")


def _chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def conversations(messages: DataFrame, top: int | None = TOP) -> DataFrame:
    """Root-to-leaf paths of reply trees, ranked and formatted.

    messages has conv_id, msg_id, parent_id, role, text and score (a number);
    other columns are ignored, whatever their names.  Result: conv_id, leaf_id, branch_rank, n_turns,
    path_score (the sum of the scores), formatted.  In each conv_id paths are
    ranked by score, greater first, then by leaf_id; the best `top` of them are
    formatted (all by default), message by message, as <|im_start|>role, line
    break, text<|im_end|>.

    A message whose parent_id is null or names no message of the conversation
    is a root, so a conversation may have several trees; they are ranked
    together.  Messages on a cycle, and those below them, are reached from no
    root and give no path.  Rows without conv_id or msg_id are left out; of
    several rows of one (conv_id, msg_id) the one of the greatest score counts,
    then of the least role and text.  A null score counts as 0, a null role as
    user, a null text as empty.  Texts are kept whole.  An empty table gives an
    empty result.
    """
    ready_to_checkpoint(messages.sparkSession)
    rows = messages.where("conv_id IS NOT NULL AND msg_id IS NOT NULL").select("conv_id", "msg_id", "parent_id", "role", "text", F.coalesce(F.col("score"), F.lit(0)).alias("score"))
    first = Window.partitionBy("conv_id", "msg_id").orderBy(F.desc("score"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), F.asc_nulls_first("parent_id"))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    node = rows.select("conv_id", "msg_id", "parent_id", "score").checkpoint()
    known = node.select("conv_id", F.col("msg_id").alias("parent_id"))
    jump = node.join(known, ["conv_id", "parent_id"]).select("conv_id", F.col("msg_id").alias("at"), F.col("parent_id").alias("up")).checkpoint()
    root = node.join(jump.select("conv_id", F.col("at").alias("msg_id")), ["conv_id", "msg_id"], "left_anti").select("conv_id", F.col("msg_id").alias("at"))
    leaf = node.join(jump.select("conv_id", F.col("up").alias("msg_id")), ["conv_id", "msg_id"], "left_anti")
    # the messages of each leaf's branch, up to 2^round of them, with their distance from the leaf
    branch = leaf.select("conv_id", F.col("msg_id").alias("leaf_id"), F.col("msg_id").alias("at"), F.lit(0).cast("long").alias("up_by"))
    largest = node.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    step = 1
    while step < largest:  # no branch is longer, and what goes round a cycle ends here too
        if jump.isEmpty():
            break
        more = branch.join(jump, ["conv_id", "at"]).select("conv_id", "leaf_id", F.col("up").alias("at"), (F.col("up_by") + step).alias("up_by"))
        branch = branch.unionByName(more).checkpoint()
        jump = jump.join(jump.select("conv_id", F.col("at").alias("up"), F.col("up").alias("over")), ["conv_id", "up"]).select("conv_id", "at", F.col("over").alias("up")).checkpoint()
        step *= 2
    # only branches that reach a root; a cycle has none
    whole = branch.join(root, ["conv_id", "at"], "left_semi").select("conv_id", "leaf_id", F.col("up_by").alias("depth"))
    turn = branch.withColumnRenamed("at", "msg_id").join(whole, ["conv_id", "leaf_id"]).join(node.select("conv_id", "msg_id", "score"), ["conv_id", "msg_id"])
    paths = turn.groupBy("conv_id", "leaf_id").agg(F.sum("score").alias("path_score"))
    paths = paths.withColumn("branch_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf_id")))
    if top is not None:
        paths = paths.where(F.col("branch_rank") <= top)
    turn = turn.select("conv_id", "leaf_id", "msg_id", (F.col("depth") - F.col("up_by")).alias("pos")).join(paths, ["conv_id", "leaf_id"])
    # texts and the places that they take come together by conversation, once
    place = F.struct("leaf_id", "branch_rank", "path_score", "pos")
    texts = rows.select("conv_id", "msg_id", _chatml(F.col("role"), F.col("text")).alias("said"), F.lit(None).alias("place"))
    places = turn.select("conv_id", "msg_id", F.lit(None).cast("string").alias("said"), place.alias("place"))
    texts = texts.withColumn("place", F.col("place").cast(places.schema["place"].dataType))
    met = texts.unionByName(places).repartition("conv_id").groupBy("conv_id", "msg_id").agg(F.first("said", ignorenulls=True).alias("said"), F.collect_list("place").alias("places"))
    said = met.select("conv_id", "said", F.inline("places"))
    whole = said.groupBy("conv_id", "leaf_id", "branch_rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("m"))
    return whole.select("conv_id", "leaf_id", "branch_rank", F.size("m").cast("long").alias("n_turns"), "path_score", F.concat_ws("", F.transform("m", lambda m: m["said"])).alias("formatted"))

"""What analysts' answers say and do, and the units they draw in from other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normalize_fact

ACTION = (
    "struct<action:string,id:string,question_id:string,target_type:string,target_number:string,detail_level:string,"
    "entry:struct<id:string,type:string,content:string,importance:string>,answer:struct<id:string,content:string>>"
)


def actions(responses: DataFrame, by: list[str], response: str = "response") -> DataFrame:
    """One row for each action in responses: an object with actions, a list, or
    one action, alone or inside other text; nothing where there is no such JSON."""
    text = F.col(response)
    inner = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    body = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(inner)
    many = F.coalesce(F.from_json(F.get_json_object(body, "$.actions"), f"array<{ACTION}>"), F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{ACTION}>")), F.array(F.from_json(body, ACTION)))
    rows = responses.where(body != "").select(*by, F.posexplode(many).alias("ord", "a"))
    return rows.select(*by, "ord", "a.*").where("action IS NOT NULL")


def entries(rows: DataFrame, by: list[str]) -> DataFrame:
    """Facts, questions, answers and requests of actions(): kind, id, content.  Entries of unknown type count as facts."""
    kind = F.when((F.col("action") == "add_entry") & (F.col("entry.type") == "question"), "question").when(F.col("action") == "add_entry", "fact").when(F.col("action") == "add_answer", "answer").when(F.col("action").isin("request_detail", "request_relevant_section"), "request")
    content = F.coalesce("entry.content", "answer.content", F.concat_ws(" ", "target_type", "target_number"))
    return rows.select(*by, "ord", kind.alias("kind"), F.coalesce("entry.id", "answer.id", "id").alias("id"), content.alias("content")).where("kind IS NOT NULL")


def compaction(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Facts that a compaction dropped or made, compared without case, quotes and spacing."""
    key = normalize_fact(F.col("content"))
    b, a = before.withColumn("k", key), after.withColumn("k", key)
    gone = b.join(a.select(*by, "k"), [*by, "k"], "left_anti").select(*by, "content", F.lit("dropped").alias("change"))
    new = a.join(b.select(*by, "k"), [*by, "k"], "left_anti").select(*by, "content", F.lit("made").alias("change"))
    return gone.unionByName(new)


def unit_of_prompt(prompt: Column) -> Column:
    """The unit that a prompt names after 'Your Portion', as type and number."""
    m = r"Your Portion[^A-Za-z]*([A-Za-z]+)\s+([\w.()\-]+)"
    return F.struct(F.lower(F.regexp_extract(prompt, m, 1)).alias("unit_type"), F.regexp_extract(prompt, m, 2).alias("unit_id"))


def cross_document_units(refs: DataFrame, scores: DataFrame, units: DataFrame, known: DataFrame) -> DataFrame:
    """Units of other documents that scored units refer to, each once, with a
    score of 2; those that are known already stay as they are.

    refs: source_type, source_number, target_doc_id, target_type, target_number; only sources scored over 0 count."""
    own = scores.where("score > 0").select(F.lower("type_name").alias("s"), F.col("unit_id").alias("source_number"))
    met = refs.withColumn("s", F.lower("source_type")).join(own, ["s", "source_number"], "left_semi").select(F.col("target_doc_id").alias("doc_id"), F.lower("target_type").alias("type_name"), F.col("target_number").alias("unit_id")).distinct()
    there = met.join(units.select("doc_id", F.lower("type_name").alias("type_name"), "unit_id"), ["doc_id", "type_name", "unit_id"], "left_semi")
    return known.unionByName(there.join(known, ["doc_id", "type_name", "unit_id"], "left_anti").withColumn("score", F.lit(2)).select(known.columns))


def scored_levels(orgs: DataFrame, own: DataFrame, scope: str | None = None, prune: str = "off") -> DataFrame:
    """Scores of org levels: own(doc_id, org_path, score) holds the model's.

    Levels above the document's scope score 1 on its branch and 0 off it, and
    nothing below the latter is scored.  prune: 'off' scores every level;
    'two_zero' leaves out those below two levels in a row that scored 0."""
    rows = orgs.join(own, ["doc_id", "org_path"], "left")
    score = F.coalesce("score", F.lit(1))
    if scope:
        n = scope.count("/") + 1
        above = F.col("depth") + 1 < n
        on = F.lit(scope).startswith(F.concat("org_path", F.lit("/")))
        start = F.array_join(F.slice(F.split("org_path", "/"), F.lit(1), F.lit(n)), "/")
        rows = rows.where(above | (start == scope)).withColumn("score", F.when(above, F.when(on, 1).otherwise(0)).otherwise(score))
        off = rows.where(above & ~on).select("doc_id", F.col("org_path").alias("off"))
        rows = rows.join(off, (rows["doc_id"] == off["doc_id"]) & F.col("org_path").startswith(F.concat("off", F.lit("/"))), "left_anti")
    else:
        rows = rows.withColumn("score", score)
    if prune == "two_zero":
        up = rows.select("doc_id", F.col("org_path").alias("parent_path"), F.col("parent_path").alias("grand_path"), F.col("score").alias("p"))
        two = up.join(rows.select("doc_id", F.col("org_path").alias("grand_path"), F.col("score").alias("g")), ["doc_id", "grand_path"]).where("p = 0 AND g = 0").select("doc_id", F.concat("parent_path", F.lit("/")).alias("cut"))
        rows = rows.join(two.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & F.col("org_path").startswith(F.col("cut")), "left_anti")
    return rows.select("doc_id", "org_path", "score")


def targets(wanted: DataFrame, units: DataFrame, primary: str, cap: int = 15) -> DataFrame:
    """Units between first_id and last_id (by position) of wanted(ref_id,
    type_key, first_id, last_id), at most `cap` of each, from the primary
    document if it has them, else from the least other one."""
    at = lambda name, pos: units.groupBy("doc_id", "type_key", F.col("unit_id").alias(name)).agg(F.min("ord").alias(pos))
    ends = wanted.join(at("first_id", "a"), ["type_key", "first_id"]).join(at("last_id", "b"), ["doc_id", "type_key", "last_id"])
    one = ends.withColumn("_n", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc(F.col("doc_id") == primary), "doc_id"))).where("_n = 1")
    met = one.join(units.select("doc_id", "type_key", "unit_id", "ord"), ["doc_id", "type_key"]).where(F.col("ord").between(F.least("a", "b"), F.greatest("a", "b")))
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("ref_id").orderBy("ord"))).where(F.col("_n") <= cap).select("ref_id", "doc_id", "type_key", "unit_id", "ord")


def applied(rows: DataFrame, by: list[str]) -> DataFrame:
    """What actions() leave in a scratch list: kind, id, question_id, content,
    source.  rows have `by`, ord, unit_label and the actions' fields.

    Entries need a type and an id, and the last one of an id counts; answers
    need a question that was entered before, and those without an id are numbered a_001 and on for each question."""
    last = Window.partitionBy(*by, "kind", "id").orderBy(F.desc("ord"))
    e = rows.where("action = 'add_entry' AND coalesce(entry.type, '') <> '' AND coalesce(entry.id, '') <> ''")
    e = e.select(*by, "ord", F.col("entry.type").alias("kind"), F.col("entry.id").alias("id"), F.coalesce("entry.content", F.lit("")).alias("content"), F.col("unit_label").alias("source"))
    kept = e.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    asked = e.where("kind = 'question'").groupBy(*by, F.col("id").alias("question_id")).agg(F.min("ord").alias("_since"))
    a = rows.where("action = 'add_answer' AND coalesce(question_id, '') <> ''").join(asked, [*by, "question_id"]).where("ord > _since")
    n = F.row_number().over(Window.partitionBy(*by, "question_id").orderBy("ord"))
    ident = F.when(F.coalesce("answer.id", F.lit("")) != "", F.col("answer.id")).otherwise(F.format_string("a_%03d", n))
    a = a.select(*by, F.lit("answer").alias("kind"), ident.alias("id"), "question_id", F.coalesce("answer.content", F.lit("")).alias("content"), F.col("unit_label").alias("source"), "ord")
    a = a.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "question_id", "id").orderBy(F.desc("ord")))).where("_n = 1")
    out = [*by, "kind", "id", "question_id", "content", "source"]
    return kept.withColumn("question_id", F.lit(None).cast("string")).select(out).unionByName(a.select(out))


def active_labels(pool: DataFrame) -> DataFrame:
    """Different labels of the units of a pool; those of other documents with the document's label before."""
    label = F.when(F.coalesce("external_doc_label", F.lit("")) != "", F.concat("external_doc_label", F.lit(" "), "unit_label")).otherwise(F.col("unit_label"))
    return pool.select(label.alias("unit_label")).distinct()


def answer_blocks(facts: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """What a final answer is asked from, a text each for facts with their
    sources, settled questions, and those that nothing was found for."""
    lines = lambda rows, line, name: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias(name))
    f = lines(facts, F.concat(F.lit("- "), F.col("content"), F.lit("  [sources: "), F.array_join("source_units", ", "), F.lit("]")), "facts")
    settled = questions.where("status IN ('answered', 'unanswerable')")
    q = lines(settled, F.concat(F.lit("- ["), F.upper("status"), F.lit("] "), F.col("text")), "questions")
    u = lines(questions.where("status = 'unanswerable'"), F.concat(F.lit("- "), F.col("text")), "unresolved")
    got = facts.select(*by).unionByName(questions.select(*by)).distinct().join(f, by, "left").join(q, by, "left").join(u, by, "left")
    return got.select(*by, F.coalesce("facts", F.lit("(No facts collected.)")).alias("facts"), F.coalesce("questions", F.lit("(No sub-questions were generated.)")).alias("questions"), F.coalesce("unresolved", F.lit("")).alias("unresolved"))


def contexts(units: DataFrame, definitions: DataFrame, referenced: DataFrame, parents: DataFrame) -> DataFrame:
    """What a unit is read with, in one text for each of units(doc_id, unit_path,
    title): its title, the definitions in force (term, value), summaries of
    units that it refers to (target_path, summary_1) and definitions of the parent document."""
    by = ["doc_id", "unit_path"]
    lines = lambda rows, order, line, name, head: rows.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("l")))), lambda x: x["l"]), "\n")).alias(name))
    said = F.concat(F.col("term"), F.lit(": "), F.col("value"))
    d = lines(definitions, ["term", "value"], said, "d", "Definitions:\n")
    r = lines(referenced, ["target_path"], F.concat(F.col("target_path"), F.lit(": "), F.col("summary_1")), "r", "Referenced:\n")
    p = lines(parents, ["term", "value"], said, "p", "Parent definitions:\n")
    got = units.select(*by, "title").join(d, by, "left").join(r, by, "left").join(p, by, "left")
    return got.select(*by, F.concat_ws("\n\n", "title", "d", "r", "p").alias("context"))

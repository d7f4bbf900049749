"""How far documents are, and the listings that reports and viewers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 30

_ZERO = {"total_2": 0, "done_2": 0, "total_op": 0, "first_op": 0, "second_op": 0, "total_org": 0, "second_org": 0, "since_checkpoint": 0}


def with_status(status: DataFrame, docs: DataFrame) -> DataFrame:
    """status with a row for each document that has none: nothing done, phase initialization.

    status: doc_id, phase_2, complete_2, complete_3, last_item and the counts
    total_2, done_2 (stage 2), total_op, first_op, second_op, total_org, second_org
    (stage 3) and since_checkpoint."""
    new = docs.select("doc_id").distinct().join(status.select("doc_id"), "doc_id", "left_anti")
    new = new.withColumns({"phase_2": F.lit("initialization"), "complete_2": F.lit(False), "complete_3": F.lit(False), "last_item": F.lit(None).cast("string"), **{k: F.lit(v) for k, v in _ZERO.items()}})
    return status.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in status.dtypes]))


def stage_2_updated(status: DataFrame, new: DataFrame) -> DataFrame:
    """new(doc_id, total_2, done_2, phase_2, set_complete): a stage is complete if
    that is said, else once all of some items are done."""
    got = status.join(new.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("total_2", "done_2", "phase_2", "set_complete")], F.lit(True).alias("_hit")), "doc_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    done = F.coalesce("_set_complete", (F.col("_total_2") > 0) & (F.col("_done_2") >= F.col("_total_2")))
    rows = got.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("total_2", "done_2", "phase_2")} | {"complete_2": F.when(hit, done).otherwise(F.col("complete_2"))})
    return rows.select(status.columns)


def stage_3_updated(status: DataFrame, new: DataFrame) -> DataFrame:
    """new(doc_id, total_op, first_op, second_op, total_org, second_org), null where
    a count stays: complete once units and levels have all their second summaries; none at all counts as all."""
    counts = ["total_op", "first_op", "second_op", "total_org", "second_org"]
    got = status.join(new.select("doc_id", *[F.col(c).alias(f"_{c}") for c in counts], F.lit(True).alias("_hit")), "doc_id", "left")
    now = {c: F.coalesce(f"_{c}", c) for c in counts}
    done = (now["second_op"] >= now["total_op"]) & (now["second_org"] >= now["total_org"])
    return got.withColumns(now | {"complete_3": F.when(F.coalesce("_hit", F.lit(False)), done).otherwise(F.col("complete_3"))}).select(status.columns)


def items_done(status: DataFrame, items: DataFrame) -> DataFrame:
    """status after items(doc_id, ord, item): the last one, and how many since the last checkpoint."""
    n = items.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max_by("item", "ord").alias("_last"))
    rows = status.join(n, "doc_id", "left")
    return rows.withColumns({"last_item": F.coalesce("_last", "last_item"), "since_checkpoint": (F.col("since_checkpoint") + F.coalesce("_n", F.lit(0))).cast(dict(status.dtypes)["since_checkpoint"])}).select(status.columns)


def checkpoint_due(status: DataFrame, every: int = EVERY) -> DataFrame:
    return status.where(F.col("since_checkpoint") >= every)


def is_processed(info: Column, content: Column) -> Column:
    """A document file is one if it has both of its top parts."""
    return info.isNotNull() & content.isNotNull()


def version_checked(rows: DataFrame, version: Column, wanted: str) -> DataFrame:
    """rows; fails when read if a row has another version."""
    return rows.where(F.assert_true(version == wanted, F.concat(F.lit("version "), F.coalesce(version.cast("string"), F.lit("none")))).isNull())


def document_statistics(docs: DataFrame) -> DataFrame:
    """Documents in all, of each parser, and by the stage that they reached: name, n."""
    named = F.explode(F.array(F.lit("all"), F.concat(F.lit("parser "), "parser_type"), F.concat(F.lit("stage "), F.col("stage_reached").cast("string"))))
    return docs.select(named.alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))


def run_counters(results: DataFrame, most: int = 10) -> DataFrame:
    """One row for a run over results(path, outcome, error, seconds): counts and the first errors."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    bad = F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.concat("path", F.lit(": "), F.coalesce("error", F.lit("unknown"))))))
    return results.agg(F.count("*").alias("n_files"), n("processed").alias("n_processed"), n("skipped").alias("n_skipped"), n("failed").alias("n_failed"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"), F.slice(bad, F.lit(1), F.lit(most)).alias("errors"))


def cache_stats(entries: DataFrame) -> DataFrame:
    """Entries and characters of a cache, and how many have an empty answer."""
    return entries.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(F.length("key") + F.length(F.coalesce("response", F.lit("")))), F.lit(0)).alias("n_chars"), F.count_if(F.coalesce(F.col("response"), F.lit("")) == "").alias("n_empty"))


def chunk_prefixes(units: DataFrame) -> DataFrame:
    return units.where("chunk_prefix IS NOT NULL")


def filterable_levels(manifests: DataFrame) -> DataFrame:
    """Level types that any file of a manifest names: level_type, n_files, from levels, a map."""
    return manifests.select(F.explode(F.map_keys("levels")).alias("level_type")).groupBy("level_type").agg(F.count("*").alias("n_files"))


def without_empty_types(types: DataFrame, units: DataFrame) -> DataFrame:
    """Unit types that a document has units of."""
    return types.join(units.select("doc_id", "type_key").distinct(), ["doc_id", "type_key"], "left_semi")


def type_named(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Operational types by name, case aside: wanted(doc_id, type_name) with type_key, the least if there are several."""
    there = types.where("operational = 1").groupBy("doc_id", F.lower("type_name").alias("_t")).agg(F.min("type_key").alias("type_key"))
    return wanted.withColumn("_t", F.lower("type_name")).join(there, ["doc_id", "_t"], "left").drop("_t")


def matching(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows that hold the needle in one of the columns, case aside; all for a blank one."""
    if not needle.strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.strip().lower())
    return rows.where(hit)


def questions_shown(questions: DataFrame, title: str | None = None, complete: bool | None = None) -> DataFrame:
    """Questions of a document and a state, newest file first."""
    if title is not None:
        questions = questions.where(F.col("title") == title)
    if complete is not None:
        questions = questions.where(F.col("complete") == complete)
    return questions.orderBy(F.desc("file_name"))


def documents_listed(manifests: DataFrame, processed: DataFrame) -> DataFrame:
    """Manifest files (path) with their processed twin's stage (path, stage_reached): state new, partial or complete."""
    twin = F.regexp_replace("path", "_parse_output", "_processed")
    rows = manifests.withColumn("_twin", twin).join(processed.select(F.col("path").alias("_twin"), "stage_reached"), "_twin", "left").drop("_twin")
    return rows.withColumn("state", F.when(F.col("stage_reached").isNull(), "new").when(F.col("stage_reached") >= 3, "complete").otherwise("partial"))


def unit_page(units: DataFrame, limit: int, offset: int = 0, type_key: str | None = None, needle: str = "") -> DataFrame:
    """A page of a document's units in order, of one type, whose id or title holds the needle."""
    rows = units if type_key is None else units.where(F.col("type_key") == type_key)
    return matching(rows, ["unit_id", "unit_title"], needle).orderBy("doc_id", "ord").offset(offset).limit(limit)


def files_added(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of manifest files by (manifest, file): a file that is there keeps its
    kind, and its levels and short title change where new ones are given; of several new rows the last counts."""
    key = ["manifest", "file"]
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ord")))).where("_n = 1").drop("_n", "ord")
    both = manifest.join(last.select(*key, *[F.col(c).alias(f"_{c}") for c in last.columns if c not in key]), key, "full")
    own = [c for c in manifest.columns if c not in key]
    return both.select(*key, *[(F.coalesce(c, f"_{c}") if c == "kind" else F.coalesce(f"_{c}", c)).alias(c) for c in own]).select(manifest.columns)


def quoted_candidates(lists: DataFrame, items: DataFrame, min_chars: int = 10_000, min_items: int = 10, sample: int = 8) -> DataFrame:
    """Lists that may define terms, for inspection: lists(list_id, n_chars,
    chapeau) long enough, with a chapeau and min_items items(list_id, ord, text);
    n_items, and how many of the first `sample` items open with a quotation mark."""
    text = F.ltrim(F.coalesce("text", F.lit("")))
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy("ord"))
    n = items.withColumns({"_n": rank, "_q": F.rlike(text, F.lit("^[\"'“‘]"))}).groupBy("list_id").agg(F.count("*").alias("n_items"), F.count_if((F.col("_n") <= sample) & F.col("_q")).alias("n_quoted"), F.least(F.count("*"), F.lit(sample)).alias("n_sample"))
    return lists.where((F.col("n_chars") >= min_chars) & F.col("chapeau").isNotNull()).join(n.where(F.col("n_items") >= min_items), "list_id")

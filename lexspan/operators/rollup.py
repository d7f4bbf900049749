"""Summaries of the organization, from the leaves up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import model as m
from lexspan.operators.ranking import batches
from lexspan.operators.state import use_shared_folder

BATCH_CHARS = 40_000


def readiness(orgs: DataFrame, units: DataFrame) -> DataFrame:
    """For each level: how many units stand directly in it and how many of them have a summary."""
    n = units.groupBy("doc_id", "org_path").agg(F.count("*").alias("n_items"), F.count_if(F.coalesce(F.col("summary_1"), F.lit("")) != "").alias("n_done"))
    return orgs.join(n, ["doc_id", "org_path"], "left").fillna(0, ["n_items", "n_done"])


def summaries(orgs: DataFrame, units: DataFrame, known: DataFrame, model: m.Model) -> DataFrame:
    """doc_id, org_path, summary_1 of all levels that are ready, deepest first.

    A level is ready if its own units and its levels below, as far as they hold
    anything, have summaries.  One part is copied; several are packed greedily
    into batches, each batch is summarised, and so are several batches' summaries.  One round
    for each depth of the tree, cut off by a checkpoint."""
    use_shared_folder(orgs.sparkSession)
    state = readiness(orgs, units).select("doc_id", "org_path", "parent_path", "depth", "ord", "n_items", "n_done")
    own = units.where("coalesce(summary_1, '') <> ''").select("doc_id", "org_path", "ord", F.col("summary_1").alias("part"))
    done = orgs.sparkSession.createDataFrame([], f"doc_id {dict(orgs.dtypes)['doc_id']}, org_path string, summary_1 string")
    for depth in range(state.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = state.where(F.col("depth") == depth)
        below = state.where(F.col("depth") == depth + 1).join(done, ["doc_id", "org_path"], "left").select("doc_id", F.col("parent_path").alias("org_path"), F.col("ord"), F.col("summary_1").alias("part"), F.col("n_items"))
        open_ = below.where("part IS NULL AND n_items > 0").select("doc_id", "org_path").distinct()
        ready = here.where("n_items = n_done").join(open_, ["doc_id", "org_path"], "left_anti").select("doc_id", "org_path")
        parts = own.unionByName(below.where("part IS NOT NULL").drop("n_items")).join(ready, ["doc_id", "org_path"], "left_semi").withColumn("size", F.length("part"))
        packed = batches(parts, ["doc_id", "org_path"], "ord", "size", 1 << 30, BATCH_CHARS).groupBy("doc_id", "org_path", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n").alias("prompt"), F.count("*").alias("n"))
        first = _said(packed, "summarise", known, model)
        whole = first.groupBy("doc_id", "org_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "text"))), lambda x: x["text"]), "\n\n").alias("prompt"), F.count("*").alias("n"))
        new = _said(whole, "combine", known, model).select("doc_id", "org_path", F.col("text").alias("summary_1"))
        done = done.unionByName(new).checkpoint()
    return done


def _said(rows: DataFrame, what: str, known: DataFrame, model: m.Model) -> DataFrame:
    """One part stands for itself; several go to the model."""
    got, _ = m.answered(rows.where("n > 1").withColumn("full_cache", F.lit(what)), known, model, ["text"])
    made = got.withColumn("text", F.get_json_object("response", "$.text")).select(*rows.columns, "text")
    return rows.where("n = 1").withColumn("text", F.col("prompt")).unionByName(made)


def top_summaries(orgs: DataFrame) -> DataFrame:
    """The summaries of the top levels in order, one text for each document."""
    rows = orgs.where("depth = 0 AND coalesce(summary_2, summary_1, '') <> ''").select("doc_id", "ord", F.coalesce("summary_2", "summary_1").alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]), "\n\n").alias("summary"))

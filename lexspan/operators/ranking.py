"""Relevance: pools of scored units, batches for scoring, budgets of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normalize_fact
from lexspan.operators.outline import most_alike

MAX_ITEMS, MAX_CHARS = 10, 10_000


def clamp(score: F.Column) -> F.Column:
    """Scores run from 0 to 3; a missing one counts as 1."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(score, F.lit(1))))


def active_pool(scores: DataFrame, units: DataFrame, least: int = 2) -> DataFrame:
    """Units scored `least` or more that have a text, or, being data tables, a
    summary; own documents before others, greater scores first, each in their order of
    insertion.  rank counts from 1."""
    met = scores.where(F.col("score") >= least).join(units, ["doc_id", "type_key", "unit_id"])
    usable = met.where("coalesce(text, '') <> '' OR (coalesce(data_table, 0) = 1 AND coalesce(summary_1, '') <> '')")
    return usable.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "is_external", "ord")))


def summary_to_score(units: DataFrame, level: str = "summary_1") -> DataFrame:
    """Units with the summary of that level, else the other; without either they drop out."""
    other = "summary_2" if level == "summary_1" else "summary_1"
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return units.withColumn("summary", F.coalesce(blank(level), blank(other))).where("summary IS NOT NULL")


def eligible(units: DataFrame, org_scores: DataFrame) -> DataFrame:
    """Units whose parent level scored over 0, and those without a parent level."""
    ok = org_scores.where("score > 0").select("doc_id", "org_path")
    top = units.where("coalesce(org_path, '') = ''")
    return units.where("coalesce(org_path, '') <> ''").join(ok, ["doc_id", "org_path"], "left_semi").unionByName(top)


def batches(rows: DataFrame, by: list[str], order: str, size: str, max_items: int = MAX_ITEMS, max_size: int = MAX_CHARS) -> DataFrame:
    """Greedy batches in order: a new one begins where the next row would be
    one too many or too much.  A row over the limit stands alone.

    Rows come sorted by group and order, and one pass goes through them, so
    that only keys and sizes reach Python and no group has to fit a row."""
    keys = [f"_k{i}" for i in range(len(by))]
    narrow = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(order).cast("long").alias("_o"), F.col(size).cast("long").alias("_s"))
    narrow = narrow.repartition(*keys).sortWithinPartitions(*keys, "_o").withColumn("_g", F.xxhash64(*keys))
    schema = ", ".join([*(f"{k} {t}" for k, t in narrow.dtypes if k in keys), "_o long, batch int"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b, n, total = None, 0, 0, 0
        for p in parts:
            out = []
            names = p.schema.names
            for g, s in zip(zip(*(p.column(names.index(k)).to_pylist() for k in ("_g", *keys))), p.column(names.index("_s")).to_pylist()):
                s = s or 0
                if g != last:
                    last, b, n, total = g, 0, 0, 0
                if n and (n >= max_items or total + s > max_size):
                    b, n, total = b + 1, 0, 0
                n, total = n + 1, total + s
                out.append(b)
            yield pa.RecordBatch.from_arrays([*(p.column(names.index(k)) for k in (*keys, "_o")), pa.array(out, pa.int32())], names=[*keys, "_o", "batch"])

    placed = narrow.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "_o", "batch")
    return rows.withColumn("_o", F.col(order).cast("long")).join(placed, [*by, "_o"]).drop("_o")


def within_budget(rows: DataFrame, by: list[str], order: str, size: F.Column, budget: F.Column | int) -> DataFrame:
    """The newest rows of each group whose sizes add up to the budget at most;
    the first that doesn't fit ends it."""
    newest = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(newest)).where(F.col("_sum") <= budget).drop("_sum")


def fact_pool(facts: DataFrame, by: list[str], threshold: int = 15_000) -> DataFrame:
    """All facts of a group if their lines fit the threshold, else the newest that do, each with its line break."""
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("content"), F.lit("  (sources: "), F.array_join("source_units", ", "), F.lit(")"))
    rows = facts.withColumn("line", line)
    every = Window.partitionBy(*by)
    rows = rows.withColumn("_all", F.sum(F.length("line") + 1).over(every) - 1)
    head = len("Most recent facts (full detail):\n")
    newest = every.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.length("line") + 1).over(newest))
    return rows.where((F.col("_all") <= threshold) | (F.col("_sum") <= threshold - head)).drop("_all", "_sum")


def neighbours(proposed: DataFrame, pool: DataFrame, threshold: float = 0.75, most: int = 3) -> DataFrame:
    """For each proposed(question_id, prop_id, content) the most similar items of its
    question's pool(question_id, item_id, content), by the ratio of matching blocks.

    The pairs are an equi-join on the question.  Those whose lengths keep the ratio
    under the threshold never reach Python, and those whose characters do, in
    whatever order, are left out there by one vectorised pass."""
    p = proposed.select("question_id", "prop_id", normalize_fact(F.col("content")).alias("p")).where("p <> ''")
    q = pool.select("question_id", "item_id", normalize_fact(F.col("content")).alias("q")).where("q <> ''")
    reach = 2 * F.least(F.length("p"), F.length("q")) >= threshold * (F.length("p") + F.length("q"))
    pairs = p.join(q, "question_id").where(reach)

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for b in batches:
            b = b.take(pa.array(np.flatnonzero(most_alike(b.column(3), b.column(4)) >= threshold)))
            c = [x.to_pylist() for x in b.columns]
            out = [SequenceMatcher(None, x, y).ratio() for x, y in zip(c[3], c[4])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.float64())], names=["question_id", "prop_id", "item_id", "similarity"])

    ident = [f"{n} {t}" for n, t in pairs.select("question_id", "prop_id", "item_id").dtypes]
    found = pairs.select("question_id", "prop_id", "item_id", "p", "q").mapInArrow(ratio, ", ".join([*ident, "similarity double"])).where(F.col("similarity") >= threshold)
    best = Window.partitionBy("question_id", "prop_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def exhausted(questions: DataFrame, seen: DataFrame, active: DataFrame) -> DataFrame:
    """Open questions that every active unit was offered: those of as many
    different active units as there are."""
    units = active.select("unit_label").distinct()
    total = units.agg(F.count("*").alias("_total"))  # one row
    met = seen.select("question_id", "unit_label").distinct().join(units, "unit_label", "left_semi").groupBy("question_id").agg(F.count("*").alias("_n"))
    open_questions = questions.where("status = 'open'").select("question_id")
    rows = open_questions.join(met, "question_id", "left").crossJoin(F.broadcast(total))
    return rows.where("coalesce(_n, 0) = _total").select("question_id")


def unseen(questions: DataFrame, seen: DataFrame, unit_label: str) -> DataFrame:
    return questions.where("status = 'open'").join(seen.where(F.col("unit_label") == unit_label).select("question_id"), "question_id", "left_anti")


def rejected_once(rows: DataFrame) -> DataFrame:
    """One row of each rejected inquiry: kind, text, source and verdict decide, the first stays."""
    first = Window.partitionBy("kind", F.trim("text"), "source_unit", F.trim(F.coalesce("gate_reason", F.lit("")))).orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def with_ids(rows: DataFrame, by: list[str], order: str, letter: str) -> DataFrame:
    """f001, f002, ... in each group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("id", F.format_string(f"{letter}%03d", n))


def merged_sources(facts: DataFrame) -> DataFrame:
    """Facts of the same content become one with all sources."""
    return facts.groupBy("question_id", normalize_fact(F.col("content")).alias("key")).agg(F.min_by("content", "ord").alias("content"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_units")))).alias("source_units"), F.min("ord").alias("ord")).drop("key")

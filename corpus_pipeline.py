"""Corpus preparation in five stages, each applied to all that the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame.  run()
writes each stage's result as Parquet into the shared folder and reads it back
as the next one's docs, which also cuts the lineage.  What the next stage has
read to its end is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import decontaminate, minhash, packing, quality_rules, substring
from lexspan.llm._spark import drop_scratch, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, blank and null texts among them.

    Rows of a null doc_id are judged like others; repeated rows one by one;
    extra columns stay; an empty table gives an empty result."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least
    doc_id, a null one counting as the greatest; of repeated rows one.  Rows
    without text stay."""
    return minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of 50 words or more are cut out of the
    texts; all rows stay, and n_chars follows the text."""
    return substring.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the table benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed, with their texts: see packing.pack()."""
    return packing.pack(docs, texts=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", bins),
]

#: Best-fit decreasing and its exchange rounds have no SQL; tests/llm holds the
#: stages against a brute-force pipeline instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over sf_dir's documents."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_scratch(spark, last)
        last = path
    return docs

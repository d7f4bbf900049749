"""Cached model answers, and what logs and damaged caches give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import cache_key


def with_key(calls: DataFrame) -> DataFrame:
    """calls: full_cache, prompt, model, max_tokens."""
    return calls.withColumn("key", cache_key(F.col("full_cache"), F.col("prompt"), F.col("model"), F.col("max_tokens")))


def first_wins(entries: DataFrame, order: str = "file_ord") -> DataFrame:
    """One entry of each key: that of the first file."""
    first = Window.partitionBy("key").orderBy(order)
    return entries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def answers(calls: DataFrame, cache: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Calls with their cached response, from the main cache, else from the old one, else null."""
    got = calls.join(cache.select("key", F.col("response").alias("_main")), "key", "left")
    if old is None:
        return got.withColumnRenamed("_main", "response")
    got = got.join(old.select("key", F.col("response").alias("_old")), "key", "left")
    return got.withColumn("response", F.coalesce("_main", "_old")).drop("_main", "_old")


def misses(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Each different call that has no answer yet, once."""
    return calls.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def added(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent."""
    return cache.select("key", "response").unionByName(first_wins(new.withColumn("_o", F.monotonically_increasing_id()), "_o").select("key", "response").join(cache.select("key"), "key", "left_anti"))


def promoted(cache: DataFrame, old: DataFrame, used: DataFrame) -> DataFrame:
    """The main cache with those entries of the old one that were used."""
    return added(cache, old.join(used.select("key").distinct(), "key", "left_semi"))


def without(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def salvaged(text: DataFrame) -> DataFrame:
    """Entries of a damaged cache file: every complete "key": {"response": "..."} in a text column `value`."""
    whole = r'"[0-9a-f]{64}"\s*:\s*\{\s*"response"\s*:\s*"(?:[^"\\]|\\.)*"\s*\}'
    rows = text.select(F.explode(F.regexp_extract_all("value", F.lit(f"({whole})"), F.lit(1))).alias("e"))
    return rows.select(F.regexp_extract("e", '"([0-9a-f]{64})"', 1).alias("key"), F.get_json_object(F.concat(F.lit("{"), F.col("e"), F.lit("}")), "$[*].response").alias("raw"), "e").select("key", F.from_json(F.regexp_extract("e", r"\{.*\}$", 0), "response string")["response"].alias("response"))


def from_log(log: DataFrame, model: str, pattern: str | None = None) -> DataFrame:
    """Cache entries of logged calls (full_cache, prompt, response), those whose prompt fits the pattern."""
    rows = log if pattern is None else log.where(F.rlike("prompt", F.lit(pattern)))
    return with_key(rows.withColumns({"model": F.lit(model), "max_tokens": F.lit(0)})).select("key", "response")

"""What changed between two versions of the units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import signature

FIELDS = ["text", "notes", "annotation", "breakpoints", "unit_title", "context", "table_html"]


def signed(units: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Units with the hash of their parsed fields; maps and arrays count as JSON."""
    kind = dict(units.dtypes)
    part = lambda c: F.to_json(F.col(c)) if kind[c].startswith(("map", "array", "struct")) else F.col(c)
    return units.withColumn("signature", signature(*[part(c) for c in fields if c in kind]))


def compared(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were modified, added or removed; each side has key and signature."""
    a = new.select(*key, F.col("signature").alias("new_signature"))
    b = old.select(*key, F.col("signature").alias("old_signature"))
    kind = F.when(F.col("old_signature").isNull(), "added").when(F.col("new_signature").isNull(), "removed").when(F.col("new_signature") != F.col("old_signature"), "modified")
    return a.join(b, key, "full_outer").withColumn("change", kind).where("change IS NOT NULL")


def sources_changed(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (path, source_hash) whose file has other content now; files: path, content."""
    return manifests.join(files.select("path", F.sha2("content", 256).alias("now")), "path").where("now <> source_hash")

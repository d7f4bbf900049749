"""Rules for single units: duplicates, metadata for prompts, offsets, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import strip


def duplicates_settled(rows: DataFrame, by: list[str], ident: str = "unit_id", order: str = "ord") -> DataFrame:
    """Repeated ids of appendix-like units: a blank one that comes later goes, a
    first blank one gives way to the first with a text, and further texts get _dup."""
    key = [*by, ident]
    has = strip(F.coalesce(F.col("text"), F.lit(""))) != ""
    w = Window.partitionBy(*key)
    n = F.row_number().over(w.orderBy(order))
    some = F.max(has.cast("int")).over(w) == 1
    rank = F.sum(has.cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumns({"_has": has, "_n": n, "_some": some, "_rank": rank}).where("_has OR (NOT _some AND _n = 1)")
    return kept.withColumn(ident, F.concat(F.col(ident), F.repeat(F.lit("_dup"), F.when(F.col("_has"), F.col("_rank") - 1).otherwise(0).cast("int")))).drop("_has", "_n", "_some", "_rank")


def metadata_suffix(units: DataFrame) -> DataFrame:
    """units with a suffix for prompts: annotation and notes of units that have a
    twin by _dup, on either side; empty for others.  notes is an array of (id, text)."""
    twins = units.where(F.col("unit_id").contains("_dup")).select("doc_id", "type_key", F.regexp_replace("unit_id", "_dup$", "").alias("unit_id"), F.lit(True).alias("_twin")).distinct()
    rows = units.join(twins, ["doc_id", "type_key", "unit_id"], "left")
    note = F.when(strip(F.coalesce(F.col("annotation"), F.lit(""))) != "", F.concat(F.lit("[ANNOTATION]: "), F.col("annotation")))
    notes = F.when(F.coalesce(F.size("notes"), F.lit(0)) > 0, F.concat(F.lit("[NOTES]: "), F.array_join(F.transform("notes", lambda x: F.concat(F.lit("Note "), x["id"], F.lit(": "), x["text"])), ", ")))
    text = F.concat_ws("\n\n", note, notes)
    member = F.col("unit_id").contains("_dup") | F.coalesce("_twin", F.lit(False))
    return rows.withColumn("suffix", F.when(member & (text != ""), F.concat(F.lit("\n\n"), text)).otherwise("")).drop("_twin")


def by_offset(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets, null if they are out of bounds."""
    return F.when((start >= 0) & (end <= F.length(text)), F.substr(text, start + 1, F.greatest(end - start, F.lit(0))))


def near_offset(text: Column, needle: Column, offset: Column, window: int = 500) -> Column:
    """Where a string begins within half a window of an offset, null if it isn't there."""
    a = F.greatest(F.lit(0), offset - window // 2)
    part = F.substr(text, (a + 1).cast("int"), F.least(F.length(text), offset + window // 2) - a)
    at = F.position(needle, part)
    return F.when(at > 0, a + at - 1)


def with_source(value: Column, source_type: Column, source_number: Column, unit_type: Column, unit_id: Column) -> Column:
    """A definition's value, with where it comes from unless that is the unit itself."""
    other = (source_type != unit_type) | (source_number != unit_id)
    return F.when(F.coalesce(other, F.lit(False)), F.concat(F.lit("(from "), source_type, F.lit(" "), source_number, F.lit(") "), value)).otherwise(value)


def work_list(parsed: DataFrame, processed: DataFrame, stage: int, force: bool = False) -> DataFrame:
    """Parsed files (path) with how far their processed twin (path, stage_reached) is; those behind `stage`, or all by force."""
    twin = F.regexp_replace("path", "_parse_output", "_processed")
    rows = parsed.withColumn("_twin", twin).join(processed.select(F.col("path").alias("_twin"), "stage_reached"), "_twin", "left").drop("_twin").fillna(1, ["stage_reached"])
    return rows if force else rows.where(F.col("stage_reached") < stage)


def output_names(files: DataFrame) -> DataFrame:
    """Different sources of one stem in a folder get _2, _3, ... so that none overwrites another."""
    n = F.row_number().over(Window.partitionBy("folder", "stem").orderBy("source"))
    return files.withColumn("output", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), n.cast("string"))))


def issues(rows: DataFrame) -> DataFrame:
    """Issues by kind with the units concerned, in order."""
    return rows.groupBy("issue_type", "issue").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.concat_ws(" ", "item_type", "item_number"))).alias("items"))

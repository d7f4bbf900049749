"""Markup as text: what can be told by patterns, without a parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TAG = r"<[a-zA-Z][a-zA-Z0-9.]*[^>]*>"


def inventory(docs: DataFrame) -> DataFrame:
    """Elements of docs(doc, markup): tag, n_elements, n_docs, has_attributes and
    the first three documents that have it."""
    e = docs.select("doc", F.explode(F.regexp_extract_all("markup", F.lit(f"({_TAG})"), F.lit(1))).alias("e"))
    per = e.groupBy(F.lower(F.regexp_extract("e", "^<([a-zA-Z0-9.]+)", 1)).alias("tag"), "doc").agg(F.count("*").alias("n"), F.bool_or(F.col("e").contains("=")).alias("a"))
    return per.groupBy("tag").agg(F.sum("n").alias("n_elements"), F.count("*").alias("n_docs"), F.bool_or("a").alias("has_attributes"), F.slice(F.array_sort(F.collect_list("doc")), 1, 3).alias("samples"))


def parents(nodes: DataFrame) -> DataFrame:
    """Different parents of each tag, from rows of node and parent tags."""
    return nodes.groupBy("tag").agg(F.countDistinct("parent_tag").alias("n_parents"))


def positions(docs: DataFrame, by: list[str], text: str, needle: str) -> DataFrame:
    """Where a string stands in each text: pos from 0, name the string itself."""
    size = F.transform(F.split(text, "\\Q" + needle + "\\E", -1), lambda p: F.length(p) + len(needle))
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(size) - 1, F.lit(1))), lambda n: F.aggregate(F.slice(size, F.lit(1), n), F.lit(0), lambda a, x: a + x) - len(needle))
    return docs.where(F.col(text).contains(needle)).select(*by, F.explode(ends).alias("pos"), F.lit(needle).alias("name"))


def eccn_marks(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """Bold control numbers such as **9E003**, as marks for gaps()."""
    found = docs.select(*by, F.col(text).alias("t"), F.posexplode(F.regexp_extract_all(text, F.lit(r"\*\*(\d[A-E]\d{3}|EAR99)"), F.lit(1))).alias("i", "name"))
    before = F.split("t", r"\*\*(?=\d[A-E]\d{3}|EAR99)", -1)
    pos = F.aggregate(F.transform(F.slice(before, F.lit(1), F.col("i") + 1), lambda p: F.length(p) + 2), F.lit(0), lambda a, x: a + x) - 2
    return found.select(*by, pos.alias("pos"), "name")


def large_tables(docs: DataFrame, by: list[str], text: str, least_rows: int = 30) -> DataFrame:
    """Tables of that many rows or more, numbered within their text."""
    t = docs.select(*by, F.posexplode(F.regexp_extract_all(text, F.lit("(?is)(<table.*?</table>)"), F.lit(1))).alias("i", "table_html"))
    rows = t.withColumn("row_count", F.regexp_count("table_html", F.lit("(?i)<tr"))).where(F.col("row_count") >= least_rows)
    caption = F.regexp_replace(F.regexp_extract("table_html", "(?is)<caption[^>]*>(.*?)</caption>", 1), "<[^>]*>", "")
    heads = F.transform(F.regexp_extract_all("table_html", F.lit("(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))
    return rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("i")).cast("string").alias("table_key"), "row_count", "table_html", caption.alias("caption"), heads.alias("headers"))


def with_placeholders(text: Column, least_rows: int = 30) -> Column:
    """A text whose large tables are replaced by their placeholders, others as they are."""
    parts = F.split(text, "(?is)(?=<table)|(?<=</table>)", -1)
    big = lambda p: p.rlike("(?i)^<table") & (F.regexp_count(p, F.lit("(?i)<tr")) >= least_rows)
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))

    def step(a: Column, p: Column) -> Column:
        n = (a["n"] + 1).cast("string")
        mark = F.concat(F.lit("[Table "), n, F.lit(" extracted as sub-unit table "), n, F.lit("]"))
        return F.when(big(p), F.struct((a["n"] + 1).alias("n"), F.concat(a["t"], mark).alias("t"))).otherwise(F.struct(a["n"].alias("n"), F.concat(a["t"], p).alias("t")))

    return F.aggregate(parts, zero, step, lambda a: a["t"])

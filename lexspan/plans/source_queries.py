"""Markup over the raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import strip_tags as without_tags
from lexspan.operators import chunking, markup_scan
from lexspan.plans._tables import table


def tag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the pages: how often, on how many pages, and up to three pages as samples."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("markup"))
    got = markup_scan.inventory(pages)
    return got.select("tag", "n_elements", "n_docs", "has_attributes", F.array_join("samples", ",").alias("samples"))


def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(without_tags(F.col("html"))).alias("text"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists taken for tables: those of five items or more leave a placeholder."""
    html = F.replace(F.replace(F.replace(F.col("html"), F.lit("ul>"), F.lit("table>")), F.lit("<li"), F.lit("<tr")), F.lit("</li>"), F.lit("</tr>"))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("text"))
    got = markup_scan.large_tables(pages, ["page_id"], "text", 5)
    return got.select("page_id", "table_key", "row_count", F.md5("table_html").alias("table_html"))


def element_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut where paragraphs open; what stands before the first is the preamble."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return chunking.sections(pages, ["page_id"], F.col("html"), "<p>").select("page_id", "pos", "name", F.md5("slice").alias("slice"))


QUERIES = {"tag_inventory": tag_inventory, "strip_tags": strip_tags, "table_rows": table_rows, "element_sections": element_sections}
ORACLES = {
    "tag_inventory": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9.]*)[^>]*>', 1)) AS tag, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9.]*([^>]*)>', 1)) AS rest FROM pages) SELECT lower(tag) AS tag, count(*) AS n_elements, count(DISTINCT page_id) AS n_docs, bool_or(contains(rest, '=')) AS has_attributes, array_to_string(list_sort(list_distinct(list(page_id)))[1:3], ',') AS samples FROM t GROUP BY 1",
    "strip_tags": r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')) AS text, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages",
    "table_rows": "WITH h AS (SELECT page_id, replace(replace(replace(html, 'ul>', 'table>'), '<li', '<tr'), '</li>', '</tr>') AS t FROM pages), x AS (SELECT page_id, unnest(regexp_extract_all(t, '(?is)<table.*?</table>')) AS table_html FROM h), n AS (SELECT *, len(regexp_extract_all(table_html, '(?i)<tr')) AS row_count FROM x) SELECT page_id, row_number() OVER (PARTITION BY page_id)::VARCHAR AS table_key, row_count::INT AS row_count, md5(table_html) AS table_html FROM n WHERE row_count >= 5",
    "element_sections": "WITH s AS (SELECT page_id, html, string_split(html, '<p>') AS a FROM pages), e AS (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM s), l AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE '<p>' END || a[i] AS slice FROM e), p AS (SELECT *, coalesce(sum(len(slice)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, count(*) OVER (PARTITION BY page_id) AS n FROM l) SELECT page_id, pos::INT AS pos, CASE i WHEN 1 THEN '_preamble' WHEN 2 THEN '<p>' ELSE '<p>_' || (i - 1) END AS name, md5(slice) AS slice FROM p WHERE n > 1",
}

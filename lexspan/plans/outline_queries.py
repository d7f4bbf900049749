"""Outlines: names, lists and headings made from parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import outline
from lexspan.plans._tables import geography, table

_KINDS = ["Supplement No. ", "SFAR ", "Policy Statement ", "Appendix ", "table ", ""]


def appendix_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", outline.appendix_kind(name).alias("k")).select("p_partkey", "k.plural", "k.ident")


def definition_list_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as paragraphs: enough of them and long enough, with a short first line as opening."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = d.select("doc_id", (F.length(F.split_part("text", F.lit("\n"), F.lit(1))) < 200).alias("chapeau"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return outline.definition_lists(lines, ["doc_id"]).select("doc_id", "n_items", "n_chars")


def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the next ones by key that are of one nation."""
    g = geography(spark, sf_dir).where("depth = 2").select("doc_id", F.col("unit_id").alias("unit_path"), F.col("parent_unit_path").alias("org_path"))
    p = g.select("doc_id", F.col("unit_path").alias("path_a"), (F.col("unit_path").cast("long") + F.col("unit_path").cast("long") % 30).cast("string").alias("path_b"))
    return outline.siblings(p, g).select("path_a", "path_b")


def commerce_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control list for each brand, its parts being the entries."""
    p = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("**"), F.col("p_size") % 9 + 1, F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("p_partkey") % 5 + 1).cast("int")), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" "), F.col("p_name"), F.lit("**"))
    text = p.groupBy("p_brand").agg(F.concat(F.lit("##HD1## Category 1\n##HD1## A. Name\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "\n")).alias("text"))
    return outline.commerce_list(text, ["p_brand"], "text").select("p_brand", "category", "section", "entry", "pos", F.md5("body").alias("body"))


_CCL_SQL = """WITH e AS (SELECT p_brand, p_partkey AS k, (p_size % 9 + 1) || ['A', 'B', 'C', 'D', 'E'][p_partkey % 5 + 1] || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS id, p_name FROM part), l AS (SELECT *, '**' || id || ' ' || p_name || '**' AS line FROM e)
SELECT p_brand, '1' AS category, 'A' AS section, id || CASE WHEN row_number() OVER (PARTITION BY p_brand, id ORDER BY k) > 1 THEN '_' || row_number() OVER (PARTITION BY p_brand, id ORDER BY k) ELSE '' END AS entry,
35 + coalesce(sum(len(line) + 1) OVER (PARTITION BY p_brand ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, md5(line) AS body FROM l"""


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with an s, looked for among the names of their brand."""
    p = table(spark, sf_dir, "part")
    needed = p.select("p_brand", F.concat(F.lit('"'), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise(""), F.lit('"')).alias("term"))
    return outline.matched_terms(needed, p.select("p_brand", F.col("p_name").alias("term")), ["p_brand"])


QUERIES = {"appendix_kinds": appendix_kinds, "definition_list_gates": definition_list_gates, "sibling_pairs": sibling_pairs, "commerce_list": commerce_list, "matched_terms": matched_terms}
ORACLES = {
    "appendix_kinds": "SELECT p_partkey, ['supplements', 'special federal aviation regulations', 'policy statements', 'appendices', 'tables', 'appendices'][p_partkey % 6 + 1] AS plural, CASE WHEN p_partkey % 6 = 0 THEN 'No. ' ELSE '' END || p_name AS ident FROM part",
    "definition_list_gates": "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(a) AS n_items, list_sum(list_transform(a, lambda x: len(x)))::BIGINT AS n_chars FROM d WHERE len(a) >= 5 AND list_sum(list_transform(a, lambda x: len(x))) >= 6000 AND len(a[1]) < 200",
    "sibling_pairs": "SELECT a.s_suppkey::VARCHAR AS path_a, b.s_suppkey::VARCHAR AS path_b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + a.s_suppkey % 30 AND b.s_nationkey = a.s_nationkey",
    "commerce_list": _CCL_SQL,
}

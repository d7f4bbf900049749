"""Defined terms: regions, nations and suppliers are the places, part names the terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import definitions as defs
from lexspan.plans._tables import GEOGRAPHY_SQL, geography, table


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for each unit of the geography: its term is its title's first
    letter, every third has an article, every fifth elaborates."""
    g = geography(spark, sf_dir)
    term = F.concat(F.when(F.col("ord") % 3 == 0, "The ").otherwise(""), F.upper(F.substring("unit_id", -1, 1)), F.lit(" term"))
    return g.select("doc_id", F.col("ord").alias("def_id"), F.col("unit_path").alias("location_path"), term.alias("term"), F.concat(F.lit("value "), F.col("ord") % 4).alias("value"), F.when(F.col("ord") % 5 == 0, "elaboration").otherwise("direct").alias("def_kind"))


_DEFS_SQL = GEOGRAPHY_SQL + ", defs AS (SELECT ord AS def_id, unit_path AS location_path, right(unit_id, 1) || ' term' AS norm_term, CASE WHEN ord % 3 = 0 THEN 'The ' ELSE '' END || right(unit_id, 1) || ' term' AS term, 'value ' || ord % 4 AS value, ord % 5 = 0 AS elaborates FROM geography)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography(spark, sf_dir).where("depth = 2").select("doc_id", "unit_path", F.col("parent_unit_path").alias("org_path"))


_SCOPED_SQL = f"""WITH {_DEFS_SQL}, u AS (SELECT unit_path, parent_unit_path AS p, split_part(parent_unit_path, '/', 1) AS q FROM geography WHERE depth = 2),
s AS (SELECT u.unit_path, d.*, CASE WHEN d.location_path = q THEN 0 WHEN d.location_path = p THEN 1 ELSE 999 END AS org_depth FROM u JOIN defs d ON d.location_path = q UNION ALL SELECT u.unit_path, d.*, 1 FROM u JOIN defs d ON d.location_path = p UNION ALL SELECT u.unit_path, d.*, 999 FROM u JOIN defs d ON d.location_path = u.unit_path)"""


def scoped_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in force at each supplier: its region's, its nation's and its own."""
    return defs.scoped(_units(spark, sf_dir), _definitions(spark, sf_dir)).select("unit_path", "def_id", "org_depth", "source_kind")


def specificity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = defs.scoped(_units(spark, sf_dir), _definitions(spark, sf_dir))
    return defs.most_specific(found).select("unit_path", "norm_term", "def_id", "org_depth", "def_kind")


_PICK_SQL = _SCOPED_SQL + """ SELECT unit_path, norm_term, def_id, org_depth, CASE WHEN elaborates THEN 'elaboration' ELSE 'direct' END AS def_kind FROM (SELECT *, dense_rank() OVER (PARTITION BY unit_path, norm_term, elaborates ORDER BY org_depth DESC) AS d,
row_number() OVER (PARTITION BY unit_path, norm_term, elaborates, lower(value) ORDER BY def_id) AS n FROM s) WHERE (NOT elaborates AND d = 1) OR (elaborates AND n = 1)"""


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    term = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "The ", "an ", "  A  ")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))
    return p.select(F.col("p_partkey").alias("def_id"), F.col("p_brand").alias("source_type"), F.col("p_type").alias("source_number"), term.alias("term"), F.concat(F.lit(" "), F.col("p_size") % 3, F.lit(" ")).alias("value"), (F.col("p_partkey") % 10 == 0).alias("quality_checked"))


_TERM_SQL = "terms AS (SELECT *, ['', 'The ', 'an ', '  A  '][p_partkey % 4 + 1] || p_name AS term, lower(p_name) AS norm_term FROM part)"


def definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defs.conflicts(_part_terms(spark, sf_dir), [])


def high_conflict_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_terms(spark, sf_dir).withColumn("term", F.concat(F.lit("The "), F.col("source_type")))
    return defs.high_conflict_terms(rows)


def parent_defs_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers need the names of their parts; those that the supplier defines (even keys) come from it, others from the parent."""
    needs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("*"), F.col("l_partkey").cast("string"), F.lit("*")).alias("ref_value"))
    own = table(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("term"))
    parent = table(spark, sf_dir, "part").where("p_size < 20").select(F.lit(0).alias("doc_id"), F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('"')).alias("term"), F.col("p_name").alias("value"))
    return defs.from_parent(needs, own, parent).select("doc_id", "term", "value")


def definition_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.element_at(F.array(F.lit(None).cast("string"), F.lit(" In this Section"), F.lit("in this chapter"), F.lit("for purposes of the Foo Act")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("def_id"), scope.alias("scope"), F.lit("section").alias("source_type"))
    return defs.route(rows).groupBy("location_kind", "scope_level").agg(F.count("*").alias("n_defs"))


def conflict_push_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of one term, all at the top, move down to where their values no longer meet."""
    g = geography(spark, sf_dir).where("depth = 2")
    rows = g.select("doc_id", F.col("ord").alias("def_id"), F.lit("").alias("location_path"), F.lit("Board").alias("term"), F.split_part("unit_path", F.lit("/"), F.lit(1)).alias("value"), F.lit(None).cast("string").alias("scope"), F.col("parent_unit_path").alias("source_path"))
    return defs.push_down(rows).select("def_id", "location_path", "n_moves")


_PUSH_SQL = f"""WITH {GEOGRAPHY_SQL} SELECT min(ord) AS def_id, split_part(unit_path, '/', 1) AS location_path, 1 AS n_moves FROM geography WHERE depth = 2 GROUP BY 2"""


def definitions_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_terms(spark, sf_dir).withColumn("doc_id", F.col("source_type")).withColumn("location_path", F.lit(""))
    return defs.duplicates_dropped(rows).select("doc_id", "def_id")


QUERIES = {
    "scoped_definitions": scoped_definitions, "specificity_pick": specificity_pick, "definition_conflicts": definition_conflicts, "high_conflict_terms": high_conflict_terms, "parent_defs_antijoin": parent_defs_antijoin,
    "definition_routing": definition_routing, "conflict_push_down": conflict_push_down, "definitions_deduplicated": definitions_deduplicated,
}
ORACLES = {
    "scoped_definitions": _SCOPED_SQL + " SELECT unit_path, def_id, org_depth, CASE org_depth WHEN 999 THEN 'item' ELSE 'organization' END AS source_kind FROM s",
    "specificity_pick": _PICK_SQL,
    "definition_conflicts": f"WITH {_TERM_SQL} SELECT norm_term, count(*) AS n_defs, count(DISTINCT p_size % 3) AS n_values FROM terms GROUP BY norm_term HAVING count(*) > 1 AND count(DISTINCT p_size % 3) > 1",
    "high_conflict_terms": "SELECT lower(p_brand) AS norm_term, count(DISTINCT p_type) AS n_sources FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1 HAVING count(DISTINCT p_type) >= 3",
    "parent_defs_antijoin": "SELECT DISTINCT l_suppkey AS doc_id, '\"' || p_partkey || '\"' AS term, p_name AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 2 = 1 AND p_size < 20",
    "definition_routing": "SELECT ['document', 'unit', 'organization', 'external'][p_partkey % 4 + 1] AS location_kind, CASE WHEN p_partkey % 4 = 2 THEN 'chapter' END AS scope_level, count(*) AS n_defs FROM part GROUP BY 1, 2",
    "conflict_push_down": _PUSH_SQL,
    "definitions_deduplicated": f"WITH {_TERM_SQL} SELECT p_brand AS doc_id, min(p_partkey) AS def_id FROM terms GROUP BY p_brand, norm_term, p_size % 3",
}

"""The driver's tables as the engine's: a tree of region, nation, customer and
so on stands for a document's organization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units: regions, their nations, the nations' suppliers; doc_id is 0.  ord is the pre-order."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rp = F.concat(F.lit("region_"), F.col("r_regionkey"))
    np = F.concat(F.lit("region_"), F.col("n_regionkey"), F.lit("/nation_"), F.col("n_nationkey"))
    key = lambda *c: sum((x.cast("long") * k for x, k in zip(c, (10**12, 10**9, 1))), F.lit(0).cast("long"))
    head = lambda t, path, parent, ident, ord_, depth, title: [F.lit(0).alias("doc_id"), F.lit(t).alias("type_key"), path.alias("unit_path"), parent.alias("parent_unit_path"), ident.cast("string").alias("unit_id"), ord_.alias("ord"), F.lit(depth).alias("depth"), title.alias("unit_title")]
    regions = r.select(*head("region", rp, F.lit(None).cast("string"), F.col("r_regionkey"), key(F.col("r_regionkey")), 0, F.col("r_name")))
    nations = n.select(*head("nation", np, F.concat(F.lit("region_"), F.col("n_regionkey")), F.col("n_nationkey"), key(F.col("n_regionkey"), F.col("n_nationkey") + 1), 1, F.col("n_name")))
    s = s.join(n.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = s.select(*head("supplier", F.concat(np, F.lit("/supplier_"), F.col("s_suppkey")), np, F.col("s_suppkey"), key(F.col("n_regionkey"), F.col("n_nationkey") + 1, F.col("s_suppkey") + 1), 2, F.col("s_name")))
    return regions.unionByName(nations).unionByName(suppliers)


GEOGRAPHY_SQL = """geography AS (
SELECT 'region' AS type_key, 'region_' || r_regionkey AS unit_path, NULL::VARCHAR AS parent_unit_path, r_regionkey::VARCHAR AS unit_id, r_regionkey::BIGINT * 1000000000000 AS ord, 0 AS depth, r_name AS unit_title FROM region
UNION ALL SELECT 'nation', 'region_' || n_regionkey || '/nation_' || n_nationkey, 'region_' || n_regionkey, n_nationkey::VARCHAR, n_regionkey::BIGINT * 1000000000000 + (n_nationkey::BIGINT + 1) * 1000000000, 1, n_name FROM nation
UNION ALL SELECT 'supplier', 'region_' || n_regionkey || '/nation_' || n_nationkey || '/supplier_' || s_suppkey, 'region_' || n_regionkey || '/nation_' || n_nationkey, s_suppkey::VARCHAR,
  n_regionkey::BIGINT * 1000000000000 + (n_nationkey::BIGINT + 1) * 1000000000 + s_suppkey + 1, 2, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

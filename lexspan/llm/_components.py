"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import ready_to_checkpoint


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return got["n"], got["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
    return both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them; a > b in edges."""
    least = F.min("b").over(Window.partitionBy("a"))
    got = edges.select("a", "b", least.alias("m"))
    pair = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
    return got.select(pair).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges(a long, b long) with the least node of their component:
    (node, component).  Alternates large and small stars until nothing changes;
    each round is cut off by a checkpoint, so that a lost executor costs one
    round.  Loops (a = b) and nulls are left out."""
    ready_to_checkpoint(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = _state(edges)
    while state[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

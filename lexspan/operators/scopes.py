"""Scope phrases resolved to places in the organization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normalize_term
from lexspan.operators.tree import nearest


def current(context: Column, kind: Column) -> Column:
    """The path down to the first entry of that type in a unit's context, null without one."""
    at = F.array_position(F.transform(context, lambda x: x["type"]), kind)
    steps = F.transform(F.slice(context, F.lit(1), F.greatest(at, F.lit(0)).cast("int")), lambda x: F.concat(x["type"], F.lit("_"), x["id"]))
    return F.when(at > 0, F.array_join(steps, "/"))


def compound(wanted: DataFrame, orgs: DataFrame) -> DataFrame:
    """Paths like (chapter III, section 2): wanted(ref_id, doc_id, org_path,
    elements array<struct<type,id>>) to found_path, null on any miss.

    The first element is found nearest to org_path; each next one is a direct
    child, else the first anywhere below.  As many joins as the longest path has elements."""
    first = wanted.where(F.size("elements") > 0).select("ref_id", "doc_id", "org_path", F.col("elements")[0]["type"].alias("level_type"), F.col("elements")[0]["id"].alias("level_id"))
    at = nearest(first, orgs).select("ref_id", "found_path").join(wanted.select("ref_id", "doc_id", "elements"), "ref_id")
    depth = wanted.agg(F.max(F.size("elements"))).first()[0] or 0
    there = orgs.select("doc_id", F.col("level_type").alias("t"), F.col("level_id").alias("i"), F.col("org_path").alias("p"), "parent_path", "ord")
    for k in range(1, depth):
        more = at.where(F.size("elements") > k)
        e = F.col("elements")[k]
        met = more.withColumns({"t": e["type"], "i": e["id"]}).join(there, ["doc_id", "t", "i"]).where(F.col("p").startswith(F.concat("found_path", F.lit("/"))))
        best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc(F.coalesce(F.col("parent_path") == F.col("found_path"), F.lit(False))), "ord"))
        step = met.withColumn("_n", best).where("_n = 1").select("ref_id", F.col("p").alias("found_path"), "doc_id", "elements")
        at = at.where(F.size("elements") <= k).unionByName(step)
    return wanted.join(at.select("ref_id", "found_path"), "ref_id", "left").select("ref_id", "found_path")


def definitions_at(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """The first definition of a term at a place: wanted(ref_id, doc_id, location_path, term).
    It is found once a place and term, before what is wanted meets it."""
    key = normalize_term(F.col("term"))
    first = F.min_by(F.struct("def_id", "value"), "def_id").alias("d")
    there = definitions.select("doc_id", "location_path", key.alias("k"), "def_id", "value").groupBy("doc_id", "location_path", "k").agg(first)
    met = wanted.withColumn("k", key).join(there, ["doc_id", "location_path", "k"])
    return met.groupBy("ref_id").agg(F.min_by("d", F.col("d")["def_id"]).alias("d")).select("ref_id", "d.*")


def indirect(definitions: DataFrame) -> DataFrame:
    """Definitions that point elsewhere (indirect_loc_path) with the value found
    there.  Each different place and term is looked up once; what points to
    itself becomes external, what isn't found goes."""
    open_ = definitions.where("indirect_loc_path IS NOT NULL")
    own = open_.where("indirect_loc_path = location_path").withColumn("location_kind", F.lit("external"))
    away = open_.where("indirect_loc_path <> location_path").withColumn("k", normalize_term(F.col("term")))
    ask = away.select("doc_id", F.col("indirect_loc_path").alias("location_path"), "k").distinct().withColumn("term", F.col("k")).withColumn("ref_id", F.concat_ws("\x1f", "doc_id", "location_path", "k"))
    found = definitions_at(ask.select("ref_id", "doc_id", "location_path", "term"), definitions.where("indirect_loc_path IS NULL"))
    got = away.withColumn("ref_id", F.concat_ws("\x1f", "doc_id", "indirect_loc_path", "k")).join(found.select("ref_id", F.col("value").alias("_v")), "ref_id").withColumn("value", F.col("_v")).drop("ref_id", "k", "_v")
    return definitions.where("indirect_loc_path IS NULL").unionByName(own).unionByName(got.select(definitions.columns))


def undeclared_sub_types(types: DataFrame, known: DataFrame) -> DataFrame:
    """Types such as paragraph that no document declares: they mean the working unit."""
    return types.where(F.lower("type_key").isin("paragraph", "subparagraph", "clause", "subclause")).join(known.select("type_key"), "type_key", "left_anti")

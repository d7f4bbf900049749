"""Document trees as rows.

units: doc_id, unit_path, parent_unit_path, type_key, unit_id, ord, depth, ...
orgs:  doc_id, org_path, parent_path, level_type, level_id, depth, ord, ...
A path is its node's whole key, so parents, children and ancestors are
equi-joins on paths and never a walk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(units: DataFrame) -> DataFrame:
    return units.where("parent_unit_path IS NOT NULL").select("doc_id", F.col("parent_unit_path").alias("unit_path")).distinct()


def leaves(units: DataFrame) -> DataFrame:
    """Units that no unit names as its parent."""
    return units.join(parents(units), ["doc_id", "unit_path"], "left_anti")


def containers(units: DataFrame) -> DataFrame:
    """Units with children, with their place in post-order: deepest first."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("depth"), "ord"))
    return units.join(parents(units), ["doc_id", "unit_path"], "left_semi").withColumn("place", place)


def operational(units: DataFrame, types: DataFrame) -> DataFrame:
    """Units of operational types, containers too; order them by ord."""
    return units.join(types.where("operational = 1").select("type_key").distinct(), "type_key", "left_semi")


def children(units: DataFrame, path: str) -> DataFrame:
    return units.where(F.col("parent_unit_path") == path)


def text_below(units: DataFrame) -> DataFrame:
    """Units below the top that have a text."""
    return units.where("depth > 0 AND text <> ''")


def of_type(units: DataFrame, type_key: str) -> DataFrame:
    return units.where(F.col("type_key") == type_key).orderBy("ord")


def level_names(orgs: DataFrame) -> DataFrame:
    return orgs.select("level_type").distinct()


def level_ids(orgs: DataFrame) -> DataFrame:
    """Each document's levels with their different ids in the order in which they first occur."""
    first = orgs.groupBy("doc_id", "level_type", "level_id").agg(F.min("ord").alias("ord"))
    got = F.array_sort(F.collect_list(F.struct("ord", "level_id")))
    return first.groupBy("doc_id", "level_type").agg(F.transform(got, lambda x: x["level_id"]).alias("level_ids"))


def lookup(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (doc_id, type_key, unit_id) the unit nearest the top, then the first."""
    best = Window.partitionBy("doc_id", "type_key", "unit_id").orderBy("depth", "ord")
    return units.join(wanted.select("doc_id", "type_key", "unit_id").distinct(), ["doc_id", "type_key", "unit_id"]).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def prefixes(c: Column) -> Column:
    """All beginnings of a string, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n))


def longest_prefix(cited: DataFrame, designators: DataFrame, covers: Callable[[Column, Column], Column], within: list[str], exact: bool = True) -> DataFrame:
    """For each row of cited(..., cited) the longest designator that covers it.

    The beginnings of what is cited are joined by equality, within the columns
    `within`, so that no pair of other strings ever meets; covers() then judges the
    boundary.  exact: a designator equal to what is cited counts too.  Rows
    without a match get null."""
    row = cited.select(*within, "cited").distinct()
    tries = row.where("cited <> ''").select(*within, "cited", F.explode(prefixes(F.col("cited"))).alias("designator"))
    ok = covers(F.col("cited"), F.col("designator"))
    met = tries.where(ok | (F.col("cited") == F.col("designator")) if exact else ok).join(designators.select(*within, "designator").distinct(), [*within, "designator"])
    best = met.groupBy(*within, "cited").agg(F.max_by("designator", F.length("designator")).alias("matched"))
    return cited.join(best, [*within, "cited"], "left")


def _range_ends(units: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with their position in the document, and wanted ranges with the
    positions a and b of their ends and the document's last one; of an id that repeats, the first place."""
    placed = units.select("doc_id", "type_key", "unit_id", "ord").withColumn("_pos", F.row_number().over(Window.partitionBy("doc_id", "type_key").orderBy("ord")))
    last = units.groupBy("doc_id", "type_key").agg(F.count("*").cast("int").alias("last"))
    at = placed.groupBy("doc_id", "type_key", "unit_id").agg(F.min("_pos").alias("at"))
    ends = wanted.join(at.select("doc_id", "type_key", F.col("unit_id").alias("first_id"), F.col("at").alias("a")), ["doc_id", "type_key", "first_id"])
    ends = ends.join(at.select("doc_id", "type_key", F.col("unit_id").alias("last_id"), F.col("at").alias("b")), ["doc_id", "type_key", "last_id"])
    return placed, ends.join(last, ["doc_id", "type_key"])


def ranges(units: DataFrame, wanted: DataFrame, parity: bool = False) -> DataFrame:
    """Units between the first and last id of each wanted(range_id, doc_id,
    type_key, first_id, last_id), by position and inclusive; nothing if an end is missing.

    parity: an end that comes again or before the other leaves the range open,
    so equal or reversed ends run to the document's end.  Many of these make
    far more rows than there are units; range_sizes() counts them without."""
    placed, ends = _range_ends(units, wanted)
    inside = F.sequence(F.least("a", "b"), F.greatest("a", "b"))
    if parity:
        inside = F.when(F.col("a") < F.col("b"), inside).otherwise(F.array_union(F.array("b"), F.sequence("a", "last")))
    # positions are exploded and joined by equality, so that a range meets no unit outside
    met = ends.select("range_id", "doc_id", "type_key", F.explode(inside).alias("_pos")).join(placed, ["doc_id", "type_key", "_pos"])
    return met.select("range_id", "doc_id", "type_key", "unit_id", "ord")


def range_sizes(units: DataFrame, wanted: DataFrame, parity: bool = False) -> DataFrame:
    """How many units ranges() finds for each range_id: range_id, n_units.
    Told from the ends' positions, without a row for each unit inside."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    size = F.abs(a - b) + 1
    if parity:
        size = F.when(a < b, size).otherwise(F.col("last") - a + 1 + (b < a).cast("long"))
    return _range_ends(units, wanted)[1].groupBy("range_id").agg(F.sum(size).alias("n_units"))


def begin_stop(units: DataFrame, by: list[str]) -> DataFrame:
    """First and last unit, in document order, of each group."""
    return units.groupBy(*by).agg(F.min_by("unit_id", "ord").alias("begin_id"), F.max_by("unit_id", "ord").alias("stop_id"))


def table_of_contents(orgs: DataFrame, units: DataFrame) -> DataFrame:
    """One indented text for each document: org levels in order, each with the
    range of its units.  orgs.org_path is found in units.org_path."""
    span = begin_stop(units, ["doc_id", "org_path"])
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.initcap("level_type"), F.lit(" "), F.col("level_id"), F.when(F.col("unit_title") != "", F.concat(F.lit(": "), F.col("unit_title"))).otherwise(F.lit("")))
    reach = F.when(F.col("begin_id").isNull(), F.lit("")).when(F.col("begin_id") == F.col("stop_id"), F.concat(F.lit(" ("), F.col("begin_id"), F.lit(")"))).otherwise(F.concat(F.lit(" ("), F.col("begin_id"), F.lit(" to "), F.col("stop_id"), F.lit(")")))
    rows = orgs.join(span, ["doc_id", "org_path"], "left").select("doc_id", "ord", F.concat(line, reach).alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("toc"))


def ancestors(path: Column, sep: str = "/") -> Column:
    """The paths above and including a path, top first."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def in_scope(path: Column, scope: Column, sep: str = "/") -> Column:
    """Whether scope is the path or above it, at a whole segment."""
    return (scope == "") | (path == scope) | path.startswith(F.concat(scope, F.lit(sep)))


def nearest(wanted: DataFrame, orgs: DataFrame) -> DataFrame:
    """For each wanted(ref_id, doc_id, org_path, level_type, level_id) the org
    unit of that type and id that shares the longest path with org_path, then
    the first in document order.  The id's case is ignored only if none has it exactly."""
    own = F.split("org_path", "/")
    parts = F.split("candidate", "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.size(parts))), lambda n: F.array_join(F.slice(own, F.lit(1), n), "/") == F.array_join(F.slice(parts, F.lit(1), n), "/")))
    there = orgs.select("doc_id", "level_type", F.lower("level_id").alias("low"), F.col("level_id").alias("their_id"), F.col("org_path").alias("candidate"), "ord")
    met = wanted.withColumn("low", F.lower("level_id")).join(there, ["doc_id", "level_type", "low"]).withColumn("shared", shared)
    best = Window.partitionBy("ref_id").orderBy(F.desc(F.col("level_id") == F.col("their_id")), F.desc("shared"), "ord")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("ref_id", "doc_id", "level_type", "level_id", F.col("candidate").alias("found_path"))


def unique_ids(rows: DataFrame, by: list[str], ident: str, order: list[str]) -> DataFrame:
    """Repeated ids get _dup once for each time they came before."""
    n = F.row_number().over(Window.partitionBy(*by, ident).orderBy(*order)) - 1
    return rows.withColumn("unique_id", F.concat(F.col(ident).cast("string"), F.repeat(F.lit("_dup"), n)))


def numbered_keys(rows: DataFrame, by: list[str], base: str, order: list[str]) -> DataFrame:
    """Repeated keys get a number from 2 on."""
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy(*order))
    return rows.withColumn("key", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), n.cast("string"))))


def next_type_key(types: DataFrame) -> DataFrame:
    """The next free number of a unit type in each document, 10 at first."""
    return types.groupBy("doc_id").agg(F.coalesce(F.max(F.col("param_key").cast("int")) + 1, F.lit(10)).alias("next_key"))


def titles_told_apart(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Titles that several documents share get their range of units appended."""
    many = F.count("*").over(Window.partitionBy("title")) > 1
    span = begin_stop(units, ["doc_id"])
    reach = F.concat(F.col("title"), F.lit(" ("), F.col("begin_id"), F.lit("–"), F.col("stop_id"), F.lit(")"))
    return docs.withColumn("_many", many).join(span, "doc_id", "left").withColumn("title", F.when(F.col("_many") & F.col("begin_id").isNotNull(), reach).otherwise(F.col("title"))).drop("_many", "begin_id", "stop_id")

"""Defined terms: scope, conflicts and the choice of the nearest definition.

definitions: doc_id, def_id, location_path ('' is the whole document), term,
value, scope, def_kind, source_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normalize_term, normalize_term_loose, strip, strip_emphasis
from lexspan.operators.tree import ancestors

ITEM_DEPTH = 999


def conflicts(definitions: DataFrame, by: list[str]) -> DataFrame:
    """Terms with two or more definitions at one place whose values differ."""
    rows = definitions.withColumn("norm_term", normalize_term(F.col("term"))).where("norm_term <> ''")
    value = strip(F.coalesce(F.col("value"), F.lit("")))
    return rows.groupBy(*by, "norm_term").agg(F.count("*").alias("n_defs"), F.countDistinct(value).alias("n_values")).where("n_defs >= 2 AND n_values > 1")


def high_conflict_terms(definitions: DataFrame, threshold: int = 3) -> DataFrame:
    """Terms whose definitions, not yet checked, come from `threshold` sources or more."""
    rows = definitions.where("NOT coalesce(quality_checked, false)").withColumn("norm_term", normalize_term_loose(F.col("term")))
    return rows.groupBy("norm_term").agg(F.countDistinct(F.struct("source_type", "source_number")).alias("n_sources")).where(F.col("n_sources") >= threshold)


def duplicates_dropped(definitions: DataFrame) -> DataFrame:
    """One definition of each place, term and value: the least def_id."""
    key = [F.col("doc_id"), F.col("location_path"), normalize_term(F.col("term")), strip(F.coalesce(F.col("value"), F.lit("")))]
    first = Window.partitionBy(*key).orderBy("def_id")
    return definitions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def conflict_classes(definitions: DataFrame) -> DataFrame:
    """Direct definitions with the others of their term and place whose values differ, as classes
    instead of pairs: doc_id, location_path, norm_term, def_id, class_id, n_links.

    class_id is the least def_id of the same place, term and value, n_links
    the number of definitions with another value.  Two definitions of one place and term
    are a conflicting pair just where their classes differ, so no pair is lost
    and none is made.  A null value differs from nothing: class_id is null, n_links 0."""
    place = ["doc_id", "location_path", "norm_term"]
    d = definitions.withColumn("norm_term", normalize_term(F.col("term"))).where("coalesce(def_kind, 'direct') <> 'elaboration' AND norm_term <> ''").select(*place, "def_id", strip(F.col("value")).alias("value"))
    classes = d.where("value IS NOT NULL").groupBy(*place, "value").agg(F.min("def_id").alias("class_id"), F.count("*").alias("n"))
    totals = classes.groupBy(*place).agg(F.sum("n").alias("total"))
    classes = classes.join(totals, place).select(*place, "value", "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    return d.join(classes, [*place, "value"], "left").select(*place, "def_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def scoped(units: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions in force at each unit: the document's (depth -1), those of
    each level above it (0, 1, ... from the top) and its own (999).

    units has doc_id, unit_path and org_path.  Each unit is expanded into the
    paths above it, and these are joined by equality."""
    place = units.select("doc_id", "unit_path", F.posexplode(F.concat(F.array(F.lit("")), F.when(F.col("org_path") == "", F.array()).otherwise(ancestors(F.col("org_path"))), F.array("unit_path"))).alias("pos", "location_path"), F.size(F.split("org_path", "/")).alias("n"))
    depth = F.when(F.col("location_path") == F.col("unit_path"), ITEM_DEPTH).otherwise(F.col("pos") - 1)
    kind = F.when(depth == -1, "document").when(depth == ITEM_DEPTH, "item").otherwise("organization")
    return place.select("doc_id", "unit_path", "location_path", depth.alias("org_depth"), kind.alias("source_kind")).join(definitions, ["doc_id", "location_path"])


def most_specific(found: DataFrame) -> DataFrame:
    """Of scoped() definitions those to use for each unit and term: all direct
    ones of the greatest depth, and elaborations, each different value once."""
    rows = found.withColumn("norm_term", normalize_term(F.col("term")))
    direct = F.coalesce(F.col("def_kind"), F.lit("direct")) != "elaboration"
    deepest = F.dense_rank().over(Window.partitionBy("doc_id", "unit_path", "norm_term", direct).orderBy(F.desc("org_depth")))
    same = F.row_number().over(Window.partitionBy("doc_id", "unit_path", "norm_term", direct, F.lower("value")).orderBy("def_id"))
    return rows.withColumn("_d", deepest).withColumn("_s", same).where((direct & (F.col("_d") == 1)) | (~direct & (F.col("_s") == 1))).drop("_d", "_s")


def needed(found: DataFrame, needs: DataFrame) -> DataFrame:
    """scoped() definitions of the terms that each unit needs (needs: doc_id,
    unit_path, ref_value), compared without emphasis marks and case."""
    key = lambda c: F.lower(strip_emphasis(c))
    want = needs.select("doc_id", "unit_path", key(F.col("ref_value")).alias("_t")).distinct()
    return found.withColumn("_t", key(F.col("term"))).join(want, ["doc_id", "unit_path", "_t"], "left_semi").drop("_t")


def from_parent(needs: DataFrame, own: DataFrame, parent: DataFrame) -> DataFrame:
    """Definitions of the parent document for needed terms that the child leaves open.
    Terms that the parent lacks go first; needs and own terms then meet in one aggregation."""
    key = lambda c: F.lower(strip_emphasis(c))
    there = parent.withColumn("t", key(F.col("term"))).drop("doc_id")
    of = lambda rows, c, own: rows.select("doc_id", key(F.col(c)).alias("t"), F.lit(own).alias("own")).join(there.select("t"), "t", "left_semi")
    both = of(needs, "ref_value", False).unionByName(of(own, "term", True)).groupBy("doc_id", "t").agg(F.bool_and("own").alias("unasked"), F.bool_or("own").alias("defined"))
    # a null doc_id equals no other, so what it needs stays open
    return both.where("NOT unasked AND (NOT defined OR doc_id IS NULL)").select("doc_id", "t").join(there, "t").drop("t")


def route(definitions: DataFrame) -> DataFrame:
    """Where a definition belongs by its scope phrase: an external act, the
    unit itself, a level of the organization, or the document."""
    s = F.lower(strip(F.coalesce(F.col("scope"), F.lit(""))))
    level = F.regexp_extract(s, r"this (\w+)", 1)
    kind = F.when(s == "", "document").when(level == "", "external").when(level == F.lower("source_type"), "unit").otherwise("organization")
    return definitions.withColumn("location_kind", kind).withColumn("scope_level", F.when(kind == "organization", level))


def express_scope(definitions: DataFrame) -> Column:
    return strip(F.coalesce(definitions["scope"], F.lit(""))) != ""


def push_down(definitions: DataFrame, rounds: int = 100) -> DataFrame:
    """Moves conflicting definitions without an express scope one level towards
    their source, again and again until nothing moves.

    A definition moves if another of the same place and term has another value
    and its source lies below the place.  One that would meet its like (same
    term and value) at the new place is dropped.  Paths get longer with each
    move, so the rounds end at the depth of the tree; each is cut off by a
    checkpoint."""
    spark = definitions.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        from lexspan.operators.state import use_shared_folder

        use_shared_folder(spark)
    now = definitions.withColumn("norm_term", normalize_term(F.col("term"))).withColumn("n_moves", F.lit(0))
    for _ in range(rounds):
        here = Window.partitionBy("doc_id", "location_path", "norm_term")
        value = strip(F.coalesce(F.col("value"), F.lit("")))
        differ = F.min(value).over(here) != F.max(value).over(here)
        depth = F.when(F.col("location_path") == "", 0).otherwise(F.size(F.split("location_path", "/")))
        path = F.split("source_path", "/")
        below = (F.col("source_path") != "") & (F.size(path) > depth) & ((F.col("location_path") == "") | F.col("source_path").startswith(F.concat("location_path", F.lit("/"))))
        moves = differ & (strip(F.coalesce(F.col("scope"), F.lit(""))) == "") & below
        new = F.array_join(F.slice(path, F.lit(1), depth + 1), "/")
        step = now.withColumn("_move", moves).select(*[c for c in now.columns if c not in ("location_path", "n_moves")], F.when(F.col("_move"), new).otherwise(F.col("location_path")).alias("location_path"), (F.col("n_moves") + F.col("_move").cast("int")).alias("n_moves"), "_move")
        first = Window.partitionBy("doc_id", "location_path", "norm_term", value).orderBy("_move", "def_id")
        step = step.withColumn("_n", F.row_number().over(first)).where("_n = 1 OR NOT _move").drop("_n").checkpoint()
        moved = step.where("_move").limit(1).count()
        now = step.drop("_move")
        if not moved:
            break
    return now

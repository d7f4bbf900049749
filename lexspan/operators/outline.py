"""Long texts cut by their own headings and lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import strip_emphasis

#: Kinds of appendix-like units by how their name opens: kind, plural.
APPENDIX_KINDS = [
    ("special federal aviation regulation", "special federal aviation regulations"), ("sfar", "special federal aviation regulations"), ("policy statement", "policy statements"), ("supplement", "supplements"),
    ("schedule", "schedules"), ("table", "tables"), ("annex", "annexes"), ("exhibit", "exhibits"), ("figure", "figures"), ("appendix", "appendices"),
]


def appendix_kind(name: Column) -> Column:
    """Plural of the kind that a name opens with, appendices if with none, and the name without it."""
    kind = None
    for word, plural in APPENDIX_KINDS:
        hit = F.lower(name).startswith(word + " ")
        value = F.struct(F.lit(plural).alias("plural"), F.substr(name, F.lit(len(word) + 2)).alias("ident"))
        kind = F.when(hit, value) if kind is None else kind.when(hit, value)
    return kind.otherwise(F.struct(F.lit("appendices").alias("plural"), name.alias("ident")))


def unit_suffix(levels: Column) -> Column:
    """A file name's suffix from a map of levels: _title1_part7, empty without any."""
    names = ["title", "subtitle", "chapter", "subchapter", "part", "subpart"]
    parts = F.array_compact(F.array(*[F.when(F.try_element_at(levels, F.lit(n)) != "", F.concat(F.lit(n), F.try_element_at(levels, F.lit(n)))) for n in names]))
    return F.when(F.size(parts) > 0, F.concat(F.lit("_"), F.array_join(parts, "_"))).otherwise("")


def clean_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^[-—–]+", ""), r"[.,:;]+$|^\s+|\s+$", "")


def marked_lines(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """Each line of a text with the offset at which it begins."""
    lines = docs.select(*by, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("pos", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def commerce_list(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """A control list cut into categories, sections and entries.

    Headings are lines like ##HD1## Category 3 or ##HD1## A. Name; entries open
    with a bold number such as **3A001. Category and section of an entry are
    carried forward over the lines, a new category ending the section; without
    a section it is 'default'. What stands before the first entry of a
    section is its _preamble; repeated entries get _2, _3, ...
    Result: by, category, section, entry, pos, body."""
    rows = marked_lines(docs, by, text)
    head = F.regexp_extract("line", r"^##HD1##\s*(.+?)\s*$", 1)
    cat = F.nullif(F.regexp_extract(head, r"(?i)^category\s+(\w+)", 1), F.lit(""))
    sec = F.when(cat.isNull(), F.nullif(F.regexp_extract(head, r'^"?([A-E])\.', 1), F.lit("")))
    entry = F.nullif(F.regexp_extract("line", r"^\*\*(\d[A-E]\d{3}|EAR99)", 1), F.lit(""))
    order = Window.partitionBy(*by).orderBy("line_no")
    rows = rows.withColumns({"c": cat, "s": sec, "e": entry})
    rows = rows.withColumn("category", F.last("c", True).over(order)).withColumn("cat_no", F.count("c").over(order))
    inside = Window.partitionBy(*by, "cat_no").orderBy("line_no")
    rows = rows.withColumn("section", F.coalesce(F.last("s", True).over(inside), F.lit("default"))).withColumn("sec_no", F.count("s").over(inside))
    place = Window.partitionBy(*by, "cat_no", "sec_no").orderBy("line_no")
    rows = rows.withColumn("entry", F.coalesce(F.last("e", True).over(place), F.lit("_preamble"))).withColumn("entry_no", F.count("e").over(place)).where("c IS NULL AND s IS NULL")
    keys = [*by, "category", "section", "cat_no", "sec_no", "entry", "entry_no"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    parts = rows.groupBy(*keys).agg(F.min("pos").alias("pos"), body.alias("body")).where("trim(body) <> ''")
    n = F.row_number().over(Window.partitionBy(*by, "category", "section", "entry").orderBy("pos"))
    return parts.withColumn("entry", F.when(n == 1, F.col("entry")).otherwise(F.concat("entry", F.lit("_"), n.cast("string")))).select(*by, "category", "section", "entry", "pos", "body")


def method_sections(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """Texts with two or more headings such as ##HD1## Method 301, each followed
    by a text, cut at them: by, section, body. Other texts give nothing."""
    rows = marked_lines(docs, by, text)
    name = F.nullif(F.regexp_extract("line", r"^##HD1##\s*((?:Method|Procedure|Test)\s+[\w.]+)", 1), F.lit(""))
    order = Window.partitionBy(*by).orderBy("line_no")
    rows = rows.withColumn("n", name).withColumn("section", F.last("n", True).over(order)).withColumn("no", F.count("n").over(order))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n"))
    parts = rows.where("no > 0").groupBy(*by, "no", "section").agg(body.alias("body"))
    every = Window.partitionBy(*by)
    return parts.withColumn("_n", F.count("*").over(every)).withColumn("_full", F.min(F.length("body")).over(every)).where("_n >= 2 AND _full > 0").drop("_n", "_full")


def definition_lists(paragraphs: DataFrame, by: list[str], least_items: int = 5, least_chars: int = 6000) -> DataFrame:
    """Units whose paragraphs (ord, text; chapeau: whether an opening text goes
    before) may be a list of definitions: enough of them, long enough, with an
    opening, and the share of them that begin with a quoted term."""
    quoted = F.avg(F.when(F.ltrim("text").rlike(r"""^(?:\(\w+\)\s*)?["“‘']"""), 1.0).otherwise(0.0))
    got = paragraphs.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum(F.length("text")).alias("n_chars"), F.bool_or("chapeau").alias("has_chapeau"), F.round(quoted, 6).alias("quoted_share"))
    return got.where((F.col("n_items") >= least_items) & (F.col("n_chars") >= least_chars) & F.col("has_chapeau")).drop("has_chapeau")


def most_alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each pair the most that the ratio of matching blocks can be, by the
    characters that both have, whatever their order, in 64 bins by code point."""

    def bins(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = x.dictionary_encode()
        words = d.dictionary.to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4") & 63
        count = np.bincount(np.repeat(np.arange(len(words)), size) * 64 + code, minlength=64 * len(words))
        return count.reshape(-1, 64).astype(np.int32), size, d.indices.to_numpy()

    (mine, m, i), (theirs, n, j) = bins(a), bins(b)
    return 2.0 * np.minimum(mine[i], theirs[j]).sum(1) / np.maximum(m[i] + n[j], 1)


def matched_terms(needed: DataFrame, known: DataFrame, by: list[str], least: float = 0.87) -> DataFrame:
    """Known terms for needed ones: equal without marks and case, else most alike
    by the ratio of matching blocks (over `least`), else the same without a
    final s. needed: by, term; known: by, term. Unmatched terms have null.

    Only terms without an equal go on to the comparison, within `by`, and of
    their pairs those whose lengths and characters allow a ratio over `least`."""
    low = lambda c: F.lower(strip_emphasis(c))
    want = needed.select(*by, "term", low(F.col("term")).alias("k")).distinct()
    have = known.select(*by, F.lower("term").alias("h")).distinct()
    equal = want.join(have.withColumnRenamed("h", "k"), [*by, "k"], "left_semi").select(*by, "term", F.col("k").alias("matched"))
    left = want.join(equal.select(*by, "term"), [*by, "term"], "left_anti")
    tries = left.select(*by, "term", F.col("k").alias("t"), F.lit(0).alias("round")).unionByName(left.where("k LIKE '%s' AND length(k) > 1").select(*by, "term", F.expr("left(k, length(k) - 1)").alias("t"), F.lit(1).alias("round")))
    pairs = tries.join(have, by).where(2 * F.least(F.length("t"), F.length("h")) > least * (F.length("t") + F.length("h")))
    cols = [*by, "term", "round", "h"]
    kinds = dict(pairs.dtypes)

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for b in batches:
            b = b.take(pa.array(np.flatnonzero(most_alike(b.column(len(cols)), b.column(len(cols) - 1)) > least)))
            t, h = b.column(len(cols)).to_pylist(), b.column(len(cols) - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(t, h)], pa.float64())], names=[*cols, "r"])

    found = pairs.select(*cols, "t").mapInArrow(ratio, ", ".join([f"{c} {kinds[c]}" for c in cols] + ["r double"])).where(F.col("r") > least)
    best = F.row_number().over(Window.partitionBy(*by, "term").orderBy("round", F.desc("r"), "h"))
    near = found.withColumn("_n", best).where("_n = 1").select(*by, "term", F.col("h").alias("matched"))
    return want.select(*by, "term").join(equal.unionByName(near), [*by, "term"], "left")


def siblings(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (doc_id, path_a, path_b) of units that stand in one org unit."""
    at = lambda name, org: units.select("doc_id", F.col("unit_path").alias(name), F.col("org_path").alias(org))
    return pairs.join(at("path_a", "_a"), ["doc_id", "path_a"]).join(at("path_b", "_b"), ["doc_id", "path_b"]).where("_a = _b").drop("_a", "_b")

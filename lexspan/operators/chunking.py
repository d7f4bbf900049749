"""Cutting long texts at prioritised breakpoints.

The recursion over breakpoint levels isn't relational, so it is one pass of
mapInArrow over the rows; a row's chunks depend on that row alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

LIMIT = 15_000
_CHUNKS = "key string, seq int, start int, end int, chunk string"


def pack_greedily(parts: list[str], joint: str, limit: int) -> list[str]:
    out: list[list[str]] = []
    size = 0
    for p in parts:
        more = len(p) + (len(joint) if out and out[-1] else 0)
        if not out or size + more > limit:
            out.append([p])
            size = len(p)
        else:
            out[-1].append(p)
            size += more
    return [joint.join(x) for x in out]


def by_white_space(text: str, limit: int) -> list[str]:
    """Pieces at blank lines, else at line breaks, else at white space, else of
    the limit's length.  A part over the limit is one piece, and the joints
    between pieces are lost."""
    if len(text) <= limit:
        return [text]
    for joint, parts in (("\n\n", text.split("\n\n")), ("\n", text.split("\n")), ("", re.split(r"(\s+)", text))):
        if len(parts) > 1 and len(pieces := pack_greedily(parts, joint, limit)) > 1:
            return pieces
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def _spans(text: str, a: int, b: int, cuts: dict[int, list[int]], levels: list[int], limit: int) -> Iterator[tuple[int, int] | str]:
    """Spans at the first level that has breakpoints inside (a, b); text where white space decided."""
    for k, level in enumerate(levels):
        inside = [p for p in cuts[level] if a < p < b]
        if inside:
            break
    else:
        if a < b:
            yield from by_white_space(text[a:b], limit)
        return

    def finer(x: int, y: int) -> Iterator[tuple[int, int] | str]:
        if k + 1 == len(levels) and y - x <= limit:
            yield x, y
        else:
            yield from _spans(text, x, y, cuts, levels[k + 1 :], limit)

    begin = good = a
    for p in inside:
        if p - begin < limit:
            good = p
            continue
        if begin != good:
            yield begin, good
            begin, good = good, p
        if p - begin >= limit or begin == good:
            yield from finer(begin, p)
            begin = good = p
    if begin < b:
        if b - begin < limit:
            yield begin, b
        else:
            if begin != good:
                yield begin, good
            yield from finer(good, b)


def chunk(text: str, breakpoints: list[tuple[int, int]], limit: int = LIMIT) -> list[str]:
    """Chunks of a text.  breakpoints are (position, level); lower levels are
    better places.  Chunks may be over the limit where no place is found."""
    if not text:
        return []
    if limit <= 0:
        return [text]
    cuts: dict[int, list[int]] = {}
    for p, level in breakpoints:
        cuts.setdefault(level, []).append(p)
    if not cuts:
        return by_white_space(text, limit)
    return [x if isinstance(x, str) else text[slice(*x)] for x in _spans(text, 0, len(text), cuts, sorted(cuts), limit)]


def strict_spans(text: str, breakpoints: list[tuple[int, int]], limit: int = LIMIT) -> list[tuple[int, int]]:
    """Spans that cover the text without loss, none over the limit: each ends at
    the last place of the best level within reach, else after white space, else
    at the limit."""
    out, a = [], 0
    places = sorted(breakpoints)
    while len(text) - a > limit > 0:
        near = [(level, -p) for p, level in places if a < p <= a + limit]
        if near:
            b = -min(near)[1]
        else:
            window = text[a : a + limit]
            b = a + (max(window.rfind("\n\n") + 2 if "\n\n" in window else 0, 0) or window.rfind("\n") + 1 or max((m.end() for m in re.finditer(r"\s", window)), default=0) or limit)
        out.append((a, b))
        a = b
    return out + ([(a, len(text))] if a < len(text) else [])


def _runs(b: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts, in column `text`, have about `most` bytes, and of 512 rows at most."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(b.column(text)).to_pylist()):
        if i > begin and (size + (n or 0) > most or i - begin == 512):
            yield b.slice(begin, i - begin)
            begin, size = i, 0
        size += n or 0
    if begin < b.num_rows:
        yield b.slice(begin)


def chunks(units: DataFrame, key: Column, text: Column, breakpoints: Column, limit: int = LIMIT, strict: bool = True) -> DataFrame:
    """Chunks of all units: key, seq, start, end, chunk.  strict: lossless and
    never over the limit, with offsets; else the looser rule of chunk(), whose
    offsets are null.  Null and empty texts give no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run at a time, as Python objects take far more memory than the batch
        for b in (r for b in batches for r in _runs(b, 1)):
            rows = []
            for k, t, bp in zip(*(c.to_pylist() for c in b.columns)):
                points = [(p["pos"], p["prio"]) for p in bp or []]
                if strict:
                    rows += [(k, i, x, y, t[x:y]) for i, (x, y) in enumerate(strict_spans(t or "", points, limit))]
                else:
                    rows += [(k, i, None, None, c) for i, c in enumerate(chunk(t or "", points, limit))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names=["key", "seq", "start", "end", "chunk"])

    return units.select(key.cast("string").alias("key"), text.alias("text"), breakpoints.cast("array<struct<pos:int,prio:int>>").alias("breakpoints")).mapInArrow(run, _CHUNKS)


def best_breakpoints(rows: DataFrame, by: list[str]) -> DataFrame:
    """The best level at each position, positions in order."""
    least = rows.groupBy(*by, "pos").agg(F.min("prio").alias("prio"))
    return least.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "prio"))).alias("breakpoints"))


def assemble(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs (ord, text) joined by line breaks, with a breakpoint where
    each but the first begins: level 1 if it opens with a designator in
    parentheses, else 2."""
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    rows = paragraphs.select(*by, "ord", "text", pos.alias("pos"), F.when(F.col("text").rlike(r"^\(\w+\)"), 1).otherwise(2).alias("prio"))
    part = F.array_sort(F.collect_list(F.struct("ord", "text", "pos", "prio")))
    got = rows.groupBy(*by).agg(part.alias("p"))
    points = F.transform(F.filter("p", lambda x: x["pos"] > 0), lambda x: F.struct(x["pos"].alias("pos"), x["prio"].alias("prio")))
    return got.select(*by, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), points.alias("breakpoints"))


def drop_blank_lines(text: str, breakpoints: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """A text without blank lines, and its breakpoints moved along; those inside
    a blank line go."""
    out, points, at, cut = [], [], 0, 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if line.isspace():
            cut += len(line)
        else:
            out.append(line)
            points += [(p - cut, q) for p, q in breakpoints if at < p <= end or p == at == 0 or (p == at and cut)]
        at = end
    return "".join(out), sorted(set(points))


def gaps(marks: DataFrame, by: list[str], text: Column, opening: str = "_preamble") -> DataFrame:
    """Slices between marks (pos from 0, name): what stands before the first is
    the opening slice; repeated names get _2, _3, ..."""
    nxt = F.lead("pos").over(Window.partitionBy(*by).orderBy("pos"))
    n = F.row_number().over(Window.partitionBy(*by, "name").orderBy("pos"))
    body = marks.withColumn("stop", F.coalesce(nxt, F.length(text))).withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), n.cast("string"))))
    head = marks.groupBy(*by).agg(F.min("pos").alias("stop"), F.any_value(text).alias("_t")).where("stop > 0").select(*by, F.lit(0).alias("pos"), F.lit(opening).alias("name"), F.substr("_t", F.lit(1), F.col("stop")).alias("slice"))
    return body.select(*by, "pos", "name", F.substr(text, F.col("pos") + 1, F.col("stop") - F.col("pos")).alias("slice")).unionByName(head)


def sections(docs: DataFrame, by: list[str], text: Column, needle: str, opening: str = "_preamble") -> DataFrame:
    """gaps() between the places where a string stands: by, pos, name, slice.
    Each text is cut by itself, where it is, and never repeated for its marks;
    texts without the string give nothing."""
    rows = docs.select(*by, text.alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("pos", IntegerType()), StructField("name", StringType()), StructField("slice", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(by)
        for b in (r for b in batches for r in _runs(b, last)):
            found = []
            for i, t in enumerate(b.column(last).to_pylist()):
                first, *parts = (t or "").split(needle)
                if parts and first:
                    found.append((i, 0, opening, first))
                at = len(first)
                for n, p in enumerate(parts, 1):
                    found.append((i, at, needle if n == 1 else f"{needle}_{n}", needle + p))
                    at += len(needle) + len(p)
            if found:
                rows, *cols = zip(*found)
                own = [c.take(pa.array(rows, pa.int32())) for c in b.columns[:last]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.string())))], names=schema.names)

    return rows.mapInArrow(run, schema)

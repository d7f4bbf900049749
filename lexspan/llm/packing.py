"""Best-fit packing with certified bin counts.

Only lengths move: each partition packs its documents' lengths by best-fit
decreasing, and dual feasible functions bound from below the bins that any
packing of them needs.  A partition whose count meets its bound is done; the
others exchange their documents among themselves by another hash and pack
again, for as long as that saves bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import ready_to_checkpoint

CAPACITY = 2048
#: Documents that one partition packs, about.
PARTITION_DOCS = 16_384
#: Bins of a partition are numbered below this.
MOST_BINS = 1 << 20

_PACKED = "part long, doc_id long, th long, piece int, n_tokens int, bin int, bins int, bound int"


def best_fit_decreasing(size: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bins of the pieces and how many there are.  Pieces come by size, larger
    first, equal ones in the order given; each goes to the fullest bin that has
    room, of equally full ones to the one that became so full last."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if some bin has room r
    out = np.empty(len(size), np.int32)
    bins = 0
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if left := room - s:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return out, bins


def lower_bound(size: np.ndarray, capacity: int) -> int:
    """The bins that any packing needs at least: the best of three families of
    dual feasible functions, each a map of sizes that may replace the sizes
    without making a feasible bin overfull."""
    if not len(size):
        return 0
    count = np.bincount(size, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, min(capacity, 100) + 1):  # rounded multiples
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity)
        v = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * v).sum()) // (k * capacity)))
    total, n = np.cumsum(count * x), np.cumsum(count)
    all_size, all_n = int(total[-1]), int(n[-1])
    for e in range(1, capacity // 2 + 1):  # the large count whole, the small not at all
        large = all_n - int(n[capacity - e])
        best = max(best, -(-(large * capacity + int(total[capacity - e]) - int(total[e - 1])) // capacity))
    for e in range(2, capacity // 2 + 1):  # what small pieces fit beside a large one
        m = capacity // e
        v = np.where(2 * x > capacity, 2 * (m - (capacity - x) // e), np.where(2 * x == capacity, m, 2 * (x // e)))
        best = max(best, -(-int((count * v).sum()) // (2 * m)))
    return min(best, all_n) if all_size else 0


def _pack(capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("th", "ascending")])
        size = t["n_tokens"].to_numpy()
        b, bins = best_fit_decreasing(size, capacity)
        n = t.num_rows
        part = pa.array(np.full(n, key[0].as_py(), np.int64))
        return pa.table([part, t["doc_id"], t["th"], t["piece"], t["n_tokens"], pa.array(b), pa.array(np.full(n, bins, np.int32)), pa.array(np.full(n, lower_bound(size, capacity), np.int32))], names=["part", "doc_id", "th", "piece", "n_tokens", "bin", "bins", "bound"])

    return run


def token_count(text: Column) -> Column:
    """Words of a text, counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\x0B\\f]+")), F.lit(0))


def _hash() -> Column:
    return F.xxhash64("text", F.col("doc_id").isNull()).alias("th")


def _cut(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts in the pieces of pieces(); put together they are the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in tx.words(b.column(2)):
                n = -(-np.diff(w.first) // capacity)
                row = np.repeat(np.arange(w.rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.where(piece == 0, w.bounds[row], w.start[np.minimum(w.first[row] + piece * capacity, len(w) - 1)] if len(w) else 0)
                end = np.where(np.append(row[1:], -1) == row, np.append(begin[1:], 0), w.bounds[row + 1])
                raw = w.data.tobytes()
                text = pa.array([raw[x:y].decode() for x, y in zip(begin.tolist(), end.tolist())], pa.string())
                where = pa.array(w.row0 + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(piece.astype(np.int32)), text], names=["k", "th", "piece", "text"])
        tx.release()

    return run


def with_texts(packed: DataFrame, docs: DataFrame, capacity: int) -> DataFrame:
    """pack()'s rows, before their hash is dropped, with the text of each piece.
    Equal rows are cut once; pieces meet their bins by equality."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k")
    texts = docs.select(key, F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text").mapInArrow(_cut(capacity), "k long, th long, piece int, text string").dropDuplicates(["k", "th", "piece"])
    return packed.withColumn("k", key).join(texts, ["k", "th", "piece"]).drop("k")


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, a hash that tells texts of one doc_id apart, piece and n_tokens:
    documents longer than a bin in pieces of a full bin and the rest."""
    n = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash(), token_count(F.col("text")).alias("n")).where("n > 0")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece")
    return n.select("doc_id", "th", "n", cut).select("doc_id", "th", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, partition_docs: int = PARTITION_DOCS, rounds: int | None = None, texts: bool = False) -> DataFrame:
    """Bins for all documents: (doc_id, piece, start_word, n_tokens, bin_id, bins, bound).

    A document's length is its number of words.  One longer than `capacity` is
    cut into pieces of a full bin and a rest, numbered from 0, so that whole
    texts are packed; start_word is a piece's first word, counted from 0.  bin_id names a bin across all partitions; bins is how
    many bins the row's partition used in the end and bound how many any
    packing of that partition's pieces needs: where they are equal the
    partition is certified.  Partitions that aren't exchange their pieces and
    pack again for as long as that saves bins, or `rounds` times if that is
    given; a new packing stands if it has fewer bins in all than the old.

    With `texts` rows have the piece's text besides, white space after it
    included, so that a document's pieces in order are its text.

    Null, empty and blank texts take no room and have no row.  Null doc_ids are
    packed like others and stay null; repeated rows are packed one by one; ties
    of length are packed in the order of doc_id and piece.  Other columns are
    ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    if partition_docs > MOST_BINS // 2:
        raise ValueError(f"partition_docs must be {MOST_BINS // 2} at most")
    lengths = pieces(docs, capacity).checkpoint()
    parts = max(1, -(-lengths.count() // partition_docs))

    def packed(rows: DataFrame, n: int, salt: int, base: int) -> DataFrame:
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(n)) + F.lit(base)
        return rows.select("doc_id", "th", "piece", "n_tokens", key.cast("long").alias("part")).groupBy("part").applyInArrow(_pack(capacity), _PACKED).checkpoint()

    now, used, r = packed(lengths, parts, 0, 0), parts, 0
    while rounds is None or r < rounds:
        r += 1
        gap = now.where("bins > bound")
        was = gap.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.count("*").alias("n"), F.sum("bins").alias("bins")).first()
        if was["n"] < 2:
            break
        new = packed(gap, was["n"], r, used)
        used += was["n"]
        bins = new.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if bins >= was["bins"]:
            break
        now = now.where("bins <= bound").unionByName(new)
    start = (F.col("piece").cast("long") * capacity).alias("start_word")
    out = [F.col("doc_id"), F.col("piece"), start, F.col("n_tokens"), (F.col("part") * MOST_BINS + F.col("bin")).alias("bin_id"), F.col("bins"), F.col("bound")]
    return with_texts(now, docs, capacity).select(*out, "text") if texts else now.select(*out)

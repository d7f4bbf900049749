"""Substring dedup with a count-min prefilter.

Every window of `window` words at every word position counts.  Three passes
over documents that are hash-partitioned once into chunks:

1. Each chunk counts its windows in a count-min sketch and sends the cells that
   it touched, packed, to the sketch's shards.  A shard adds up what the chunks
   sent and tells each of them which of its cells reach two.
2. A chunk keeps the windows all of whose cells reached two: a count-min
   estimate never falls below the count, so no repeated window is lost.  These
   go, combined within the chunk, under a 128-bit hash to exact grouping.  Each
   group answers with one byte: not repeated, repeated, or repeated and first.
3. The chunk turns the answers into spans.

The sketch's width follows the corpus, so estimates are as sharp at any size,
and no part of it is ever broadcast or collected: shards and chunks are rows.
A hot window reaches a shard once per chunk, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import chunked, free_name, in_order, layout, text_bytes

U64 = np.uint64
WINDOW = 50
DEPTH = 2
#: Cells of a sketch row for each window of the corpus, at least.
LOAD = 8
#: Cells of a piece that a shard adds up at a time, at least, on average.
PIECE = 4096

_CELLS = "_chunk int, kind int, shard int, body binary, counts binary"
_HOT = "_chunk int, kind int, shard int, body binary"
_GROUPS = "_chunk int, kind int, shard int, h1 binary, h2 binary, first binary, counts binary"
_NO_ID = np.iinfo(np.int64).max


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64; nulls come after every number."""
    return col.cast(pa.int64()).fill_null(_NO_ID).to_numpy()


def _all_windows(t: pa.Table, n: int) -> Iterator[tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece: its words, rolling hashes, and the windows' first words and rows."""
    for w in tx.words(t["text"]):
        at, row = tx.windows(w, n)
        yield w, tx.rolling(w.hash, n), at, row


def _cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return tx.mix(h, 10 + row) >> U64(64 - bits)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted x."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _sketch(n: int, depth: int, bits: int, shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = [r[at] for _, r, at, _ in _all_windows(t, n)]
        h = np.concatenate(h) if h else np.zeros(0, U64)
        rows = []
        for d in range(depth):
            cells = np.sort(_cell(h, d, bits))
            start = _runs(cells)
            counts = np.minimum(np.diff(np.r_[start, len(cells)]), 255).astype(np.uint8)
            cells = cells[start]
            cut = np.searchsorted(cells, _bounds(bits, shards))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[k], cut[k + 1]
                rows.append((key[0].as_py(), d, k, tx.put_sorted(cells[a:b]), counts[a:b].tobytes()))
        return _table(rows, ("_chunk", "kind", "shard", "body", "counts"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    return run


def _bounds(bits: int, shards: int) -> np.ndarray:
    """First cells of the shards of a sketch row, and the end of the last."""
    return np.array([(k << bits) // shards for k in range(shards + 1)], U64)


def _table(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=list(names))


def _merge_sketch(bits: int, shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adds the chunks' parts of one shard, stretch by stretch; tells each chunk its cells of two or more."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[1].as_py()
        low, high = ((k << bits) // shards for k in (shard, shard + 1))
        parts = [tx.get_sorted(b) for b in t["body"].to_pylist()]
        counts = [np.frombuffer(c, np.uint8) for c in t["counts"].to_pylist()]
        hot = [np.zeros(len(p), bool) for p in parts]
        steps = max(1, sum(map(len, parts)) // (PIECE * max(1, len(parts))))
        edge = np.array([low + (high - low) * k // steps for k in range(steps + 1)], U64)
        cuts = [np.searchsorted(p, edge) for p in parts]
        for k in range(steps):
            total = np.zeros(int(edge[k + 1] - edge[k]), np.uint8)
            here = [slice(c[k], c[k + 1]) for c in cuts]
            at = [(p[x] - edge[k]).astype(np.int64) for p, x in zip(parts, here)]
            for cells, c, x in zip(at, counts, here):
                total[cells] = np.minimum(total[cells] + np.minimum(c[x], 2), 2)
            for h, cells, x in zip(hot, at, here):
                h[x] = total[cells] >= 2
        rows = [(chunk, key[0].as_py(), shard, tx.put_sorted(p[h])) for chunk, p, h in zip(t["_chunk"].to_pylist(), parts, hot) if h.any()]
        return _table(rows, ("_chunk", "kind", "shard", "body"), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))

    return run


class _Members:
    """Membership in a sorted array: a bitmap turns most others away before the search."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.bits = max(16, int(len(x)).bit_length() + 3)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._slot(x)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def among(self, x: np.ndarray) -> np.ndarray:
        """Positions in x of the members."""
        if not len(self.x):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.map[self._slot(x)])
        y = x[maybe]
        at = np.minimum(np.searchsorted(self.x, y), len(self.x) - 1)
        return maybe[self.x[at] == y]


class _Hot:
    """Windows of a chunk that the sketch takes for repeated, piece by piece."""

    def __init__(self, hot: pa.Table, n: int, depth: int, bits: int) -> None:
        got: list[list] = [[] for _ in range(depth)]
        for kind, shard, body in zip(hot["kind"].to_pylist(), hot["shard"].to_pylist(), hot["body"].to_pylist()):
            if kind < depth:
                got[kind].append((shard, body))
        self.rows = [_Members(np.concatenate([tx.get_sorted(b) for _, b in sorted(g)]) if g else np.zeros(0, U64)) for g in got]
        self.n, self.bits = n, bits

    def of(self, t: pa.Table) -> Iterator[tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for w, r, at, row in _all_windows(t, self.n):
            h = r[at]
            keep = np.arange(len(h))
            for d, m in enumerate(self.rows):
                keep = keep[m.among(_cell(h[keep], d, self.bits))]
            at, row = at[keep], row[keep]
            h2 = tx.rolling(w.hash, self.n, 1)[at] if len(at) else np.zeros(0, U64)
            yield w, h[keep], h2, at, row


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (h1, h2) and the starts of its groups."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)


def _exact_shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _candidates(n: int, depth: int, bits: int, shards: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table, hot: pa.Table) -> pa.Table:
        t = in_order(t)
        ids = _ids(t["doc_id"])
        got = [(h1, h2, ids[w.row0 + row]) for w, h1, h2, _, row in _Hot(hot, n, depth, bits).of(t)]
        h1, h2, doc = (np.concatenate(x) if got else np.zeros(0, U64) for x in (zip(*got) if got else [[]] * 3))
        order, start = _grouped(h1, h2)
        counts = np.minimum(np.diff(np.r_[start, len(order)]), 255).astype(np.uint8)
        first = order[start]  # rows are in order and the sort is stable
        h1, h2, doc = h1[first], h2[first], doc[first]
        shard = _exact_shard(h1, shards)
        cut = np.r_[_runs(shard), len(shard)]
        rows = [(key[0].as_py(), depth, int(shard[a]), tx.put_sorted(h1[a:b]), h2[a:b].tobytes(), tx.planes(doc[a:b]), counts[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        del h1, h2, doc, order, got
        tx.release()
        return _table(rows, ("_chunk", "kind", "shard", "h1", "h2", "first", "counts"), (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4))

    return run


def _group(key: tuple, t: pa.Table) -> pa.Table:
    """Counts the windows of one shard; answers each chunk in the order it sent them."""
    read = (("h1", tx.get_sorted), ("h2", lambda b: np.frombuffer(b, U64)), ("first", lambda b: tx.from_planes(b, np.int64)), ("counts", lambda b: np.frombuffer(b, np.uint8)))
    sent = [[f(b) for b in t[c].to_pylist()] for c, f in read]
    size = [len(x) for x in sent[0]]
    h1, h2, doc, count = map(np.concatenate, sent)
    order = np.lexsort((doc, h2, h1))
    a, b = h1[order], h2[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    says = np.repeat((total >= 2).astype(np.uint8), np.diff(np.r_[start, len(order)]))
    says[start] *= 2  # the first one; a doc_id is in one chunk only, so there are no ties
    answer = np.empty(len(order), np.uint8)
    answer[order] = says
    cut = np.r_[0, np.cumsum(size)]
    rows = [(c, key[0].as_py(), key[1].as_py(), answer[i:j].tobytes()) for c, i, j in zip(t["_chunk"].to_pylist(), cut[:-1], cut[1:])]
    return _table(rows, ("_chunk", "kind", "shard", "body"), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))


def _states(t: pa.Table, hot: pa.Table, n: int, depth: int, bits: int) -> Iterator[tuple[tx.Words, np.ndarray]]:
    """For each piece of the chunk, each word's state: 0 in no repeated window,
    1 in first occurrences only, 2 in a later occurrence of some window."""
    pieces = list(_Hot(hot, n, depth, bits).of(t))
    h1 = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, U64)
    h2 = np.concatenate([p[2] for p in pieces]) if pieces else np.zeros(0, U64)
    order, start = _grouped(h1, h2)
    answers = sorted((s, b) for k, s, b in zip(hot["kind"].to_pylist(), hot["shard"].to_pylist(), hot["body"].to_pylist()) if k == depth)
    says = np.frombuffer(b"".join(b for _, b in answers), np.uint8)
    if len(says) != len(start):
        raise RuntimeError("the chunk's windows differ from those it sent")
    sorted_state = np.repeat((says > 0) * np.uint8(2), np.diff(np.r_[start, len(order)]))
    sorted_state[start[says == 2]] = 1
    state = np.empty(len(order), np.uint8)
    state[order] = sorted_state
    done = 0
    for w, a, _, at, _ in pieces:
        s = state[done : done + len(a)]
        done += len(a)
        out = np.zeros(len(w), np.uint8)
        for v in (1, 2):
            begin = at[s == v]
            if len(begin):
                depth_at = np.zeros(len(w) + 1, np.int32)
                np.add.at(depth_at, begin, 1)
                np.add.at(depth_at, begin + n, -1)
                out[np.cumsum(depth_at[:-1]) > 0] = v
        yield w, out


def _spans(n: int, depth: int, bits: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table, hot: pa.Table) -> pa.Table:
        t = in_order(t)
        out: list[list] = [[], [], [], []]
        for w, s in _states(t, hot, n, depth, bits):
            if not s.any():
                continue
            row = w.row_of_word()
            start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (row[1:] != row[:-1])])
            end = np.r_[start[1:], len(s)]
            keep = s[start] > 0
            start, end = start[keep], end[keep]
            r = row[start]
            for o, x in zip(out, (w.row0 + r, start - w.first[r], end - w.first[r], s[start] == 2)):
                o.append(x)
        at, a, b, later = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        ids = t["doc_id"].cast(pa.int64()).take(pa.array(at.astype(np.int64)))
        return pa.table({"doc_id": ids, "start_word": pa.array(a, pa.int64()), "end_word": pa.array(b, pa.int64()), "removable": pa.array(later.astype(bool), pa.bool_())})

    return run


def _cleaned(n: int, depth: int, bits: int, columns: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table, hot: pa.Table) -> pa.Table:
        t = in_order(t)
        texts = t["text"].to_pylist()
        touched: set[int] = set()
        for w, s in _states(t, hot, n, depth, bits):
            gone = s == 2
            if not gone.any():
                continue
            for r in np.unique(w.row_of_word()[gone]).tolist():
                a, b = int(w.first[r]), int(w.first[r + 1])
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, ~g, False].astype(np.int8)))
                parts = []
                for x, y in zip(edge[::2] + a, edge[1::2] + a):
                    stop = w.start[y] if y < b else w.bounds[r + 1]
                    parts.append(w.data[w.start[x] if x > a else w.bounds[r] : stop].tobytes())
                left = b"".join(parts)
                touched.add(w.row0 + r)
                texts[w.row0 + r] = (left.rstrip(tx.SPACE) if g[-1] else left).decode()
        if touched:
            t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, t.schema.field("text").type))
            if "n_chars" in t.column_names:
                new = [len(x) if r in touched else c for r, (x, c) in enumerate(zip(texts, t["n_chars"].to_pylist()))]
                t = t.set_column(t.schema.get_field_index("n_chars"), "n_chars", pa.array(new, t.schema.field("n_chars").type))
        tx.release()
        return t.select(columns)

    return run


def _plan(docs: DataFrame, window: int, depth: int, chunk_bytes: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Chunked documents, all answers for the chunks, and the bits of a cell."""
    size = text_bytes(docs)
    chunks, shards = layout(size, chunk_bytes)
    # windows are about as many as words, and a word takes six bytes with its space
    bits = max(16, int(LOAD * size // 6).bit_length())
    base = chunked(docs, chunks)
    key = F.col("_chunk")
    hot = base.groupBy(key).applyInArrow(_sketch(window, depth, bits, shards), _CELLS).groupBy("kind", "shard").applyInArrow(_merge_sketch(bits, shards), _HOT)
    exact = base.groupBy(key).cogroup(hot.groupBy(key)).applyInArrow(_candidates(window, depth, bits, shards), _GROUPS).groupBy("kind", "shard").applyInArrow(_group, _HOT)
    return base, hot.unionByName(exact), bits


def repeated_spans(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, chunk_bytes: int | None = None) -> DataFrame:
    """Maximal runs of words that lie in windows which occur twice or more in docs.

    docs needs doc_id (an integer) and text; other columns are ignored, whatever
    their names.  Result: doc_id, start_word, end_word (exclusive, counted from
    0), removable.  A run is removable if each of its words lies in a window
    that also begins earlier, in the order of (doc_id, text, position); runs of
    first occurrences have removable = false.

    Null and empty texts, and texts of fewer than `window` words, give no rows.
    Texts are processed whole, however long.  Rows with a null doc_id come last
    in the order and keep the null.  Repeated rows (same doc_id, same text) are
    occurrences like any other: the first is kept.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base, answers, bits = _plan(docs, window, depth, chunk_bytes)
    schema = "doc_id long, start_word long, end_word long, removable boolean"
    return base.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_spans(window, depth, bits), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, chunk_bytes: int | None = None) -> DataFrame:
    """docs without the removable words that repeated_spans() finds.

    All rows and columns stay, in the columns' order; text loses the removable
    runs with the white space after them, and n_chars, where there is one,
    follows for the rows of a changed text.  A text all of whose words go
    becomes empty.  Nulls stay null.
    """
    names = docs.columns
    if "_chunk" in [c.lower() for c in names]:
        other = free_name(docs, "_chunk")
        return without_repeats(docs.withColumnRenamed("_chunk", other), window, depth, chunk_bytes).toDF(*names)
    base, answers, bits = _plan(docs, window, depth, chunk_bytes)
    return base.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_cleaned(window, depth, bits, names), docs.schema)

"""Substring dedup with suffix arrays.

Documents are cut where content says so, not where a partition happens to end:
each window of `window` words is represented by its least k-gram (winnowing), so
equal windows have the same anchor at the same place.  Anchors that occur once
in the corpus are out, as no window around them repeats; the text around the others goes to the block of the
anchor's hash, where all occurrences meet.  A block builds one suffix array over
its words in two stages: suffixes smaller than their successors are sorted
directly, all others are induced by a scan of the buckets.  Then the lengths of
adjacent common prefixes are computed; those of `window` words or more are the repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import chunked, in_order, layout, text_bytes

U64 = np.uint64
WINDOW = 50
#: Words of an anchor.
ANCHOR = 16
_NO_ID = np.iinfo(np.int64).max

_SENT = "_chunk int, shard int, body binary, counts binary"
_HOT = "_chunk int, body binary"
_SEGMENTS = "block int, _chunk int, body binary, windows int, docs binary, rows binary, begins binary"
_FOUND = "_chunk int, row int, doc_id long, begin int, windows int, later boolean"


def _sliding_argmin(h: np.ndarray, n: int) -> np.ndarray:
    """Index of the least of each n consecutive values, the leftmost of equal ones."""
    m = (h & U64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=U64)
    span = 1
    while span * 2 <= n:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < n:
        m = np.minimum(m[: len(h) - n + 1], m[n - span : n - span + len(h) - n + 1])
    return (m & U64(0xFFFFFFFF)).astype(np.int64)


def _anchors(t: pa.Table, window: int, k: int) -> Iterator[tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece: words; the anchors' hashes; first windows, numbers of windows and rows."""
    for w in tx.words(t["text"]):
        at, row = tx.windows(w, window)
        if not len(at):
            continue
        h = tx.rolling(w.hash, k)
        anchor = _sliding_argmin(h, window - k + 1)[at]
        start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        yield w, h[anchor[start]], at[start], np.diff(np.r_[start, len(at)]), row[start]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _send(window: int, k: int, shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = [a for _, a, *_ in _anchors(t, window, k)]
        h = np.sort(np.concatenate(h)) if h else np.zeros(0, U64)
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        counts = np.minimum(np.diff(np.r_[start, len(h)]), 255).astype(np.uint8)
        h = h[start]
        cut = np.searchsorted(_shard(h, shards), np.arange(shards + 1))
        some = [s for s in range(shards) if cut[s] < cut[s + 1]]
        cols = [[key[0].as_py()] * len(some), some, [tx.put_sorted(h[cut[s] : cut[s + 1]]) for s in some], [counts[cut[s] : cut[s + 1]].tobytes() for s in some]]
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["_chunk", "shard", "body", "counts"])

    return run


def _repeated(key: tuple, t: pa.Table) -> pa.Table:
    """Tells each chunk which of its anchors occur twice or more in the corpus."""
    sent = [tx.get_sorted(b) for b in t["body"].to_pylist()]
    h = np.concatenate(sent)
    count = np.concatenate([np.frombuffer(b, np.uint8) for b in t["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(h)
    s = h[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    hot = np.empty(len(h), bool)
    hot[order] = np.repeat(np.add.reduceat(count[order], start) >= 2, np.diff(np.r_[start, len(s)]))
    cut = np.r_[0, np.cumsum([len(x) for x in sent])]
    rows = [(c, x[hot[a:b]]) for c, x, a, b in zip(t["_chunk"].to_pylist(), sent, cut[:-1], cut[1:])]
    rows = [(c, tx.put_sorted(x)) for c, x in rows if len(x)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["_chunk", "body"])


def _segments(window: int, k: int, blocks: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Text around the chunk's repeated anchors, each different one once with its occurrences."""

    def run(key: tuple, t: pa.Table, hot: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([tx.get_sorted(b) for b in hot["body"].to_pylist()])) if hot.num_rows else np.zeros(0, U64)
        found: dict[bytes, tuple[int, int, list, list, list]] = {}
        if len(known):
            t = in_order(t)
            ids = t["doc_id"].cast(pa.int64()).fill_null(_NO_ID).to_numpy()
            for w, h, at, n, row in _anchors(t, window, k):
                pick = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                raw = w.data.tobytes()
                block = _shard(tx.mix(h[pick], 61), blocks)
                a, b = w.start[at[pick]], w.end[at[pick] + n[pick] + window - 2]
                r = w.row0 + row[pick]
                first = w.first[row[pick]]
                for x, y, g, m, d, i, p in zip(a.tolist(), b.tolist(), block.tolist(), n[pick].tolist(), ids[r].tolist(), r.tolist(), (at[pick] - first).tolist()):
                    s = found.setdefault(raw[x:y], (g, m, [], [], []))
                    s[2].append(d)
                    s[3].append(i)
                    s[4].append(p)
        values = list(found.values())
        cols = [
            pa.array([v[0] for v in values], pa.int32()), pa.array([key[0].as_py()] * len(values), pa.int32()), pa.array(list(found), pa.binary()), pa.array([v[1] for v in values], pa.int32()),
            pa.array([np.array(v[2], np.int64).tobytes() for v in values], pa.binary()), pa.array([np.array(v[3], np.int32).tobytes() for v in values], pa.binary()), pa.array([np.array(v[4], np.int32).tobytes() for v in values], pa.binary()),
        ]
        return pa.table(cols, names=["block", "_chunk", "body", "windows", "docs", "rows", "begins"])

    return run


def suffix_array(s: np.ndarray) -> np.ndarray:
    """All suffixes of s in order.  s holds numbers of 1 or more, and zeros as
    ends of pieces: an end is less than every number and than the ends after it,
    and the last value is one.

    Suffixes smaller than their successors, ends among them, are sorted by
    comparison, up to the ends of their pieces; the scan then meets each other suffix's
    successor before the place of the suffix itself, and puts it at the next
    free place of its bucket."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(s == 0)
    # smaller than the successor: decided where the run of equal numbers ends
    change = np.flatnonzero(s[1:] != s[:-1])
    at = np.searchsorted(change, np.arange(n - 1))
    smaller = np.zeros(n, bool)
    inside = at < len(change)
    c = change[at[inside]]
    smaller[:-1][inside] = s[c] < s[c + 1]
    smaller[ends] = True
    top = int(s.max()) + 1
    kind, width = (">u2", 2) if top < 65536 else (">u4", 4)
    buf = s.astype(kind).tobytes()
    sorted_by_text = np.flatnonzero(smaller & (s > 0))
    stop = (ends[np.searchsorted(ends, sorted_by_text)] * width).tolist()
    direct = sorted_by_text.tolist()
    key = {i: buf[i * width : e] for i, e in zip(direct, stop)}
    direct.sort(key=key.__getitem__)  # stable: of equal ones the one whose end comes first
    del key
    size = np.bincount(s, minlength=top)
    end = np.cumsum(size)
    count_direct = np.bincount(s[smaller], minlength=top)
    sa = np.full(n, -1, np.int64)
    d = np.concatenate([ends, np.array(direct, np.int64)])
    # in a bucket the induced ones come first
    rank = np.arange(len(d)) - np.repeat(np.cumsum(count_direct) - count_direct, count_direct)
    sa[(end - count_direct)[s[d]] + rank] = d
    out, text, induced, head = sa.tolist(), s.tolist(), (~smaller).tolist(), (end - size).tolist()
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and induced[j]:
            c = text[j]
            out[head[c]] = j
            head[c] += 1
    return np.array(out, np.int64)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix the numbers that it and the one before it in sa begin with
    alike, before either's piece ends; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    pair = np.arange(1, len(sa))
    k = 0
    while len(pair):
        a, b = s[sa[pair] + k], s[sa[pair - 1] + k]
        pair = pair[(a == b) & (a > 0)]
        k += 1
        out[pair] = k
    return out


def _block(window: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        hashes, size = [], []
        for w in tx.words(t["body"].cast(pa.string())):
            hashes.append(w.hash)
            size.append(np.diff(w.first))
        size = np.concatenate(size)
        n = len(size)
        _, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        first = np.cumsum(size + 1) - size - 1  # a zero ends each segment
        s = np.zeros(len(ids) + n, np.int64)
        s[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids + 1
        sa = suffix_array(s)
        group_at = np.empty(len(s), np.int64)
        group_at[sa] = np.cumsum(common_prefixes(s, sa) < window)
        # the segments' occurrences, each segment's first one first
        docs, rows, begins = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("docs", np.int64), ("rows", np.int32), ("begins", np.int32)))
        times = np.array([len(b) // 8 for b in t["docs"].to_pylist()])
        order = np.lexsort((begins, rows, docs, np.repeat(np.arange(n), times)))
        docs, rows, begins = docs[order], rows[order], begins[order]
        chunk = np.repeat(t["_chunk"].to_numpy(), times)
        lead = np.cumsum(times) - times
        # the segments' windows; equal ones are a group, whose first occurrence is one of a segment's first
        windows = t["windows"].to_numpy()
        seg = np.repeat(np.arange(n), windows)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = group_at[first[seg] + off]
        order = np.lexsort((begins[lead[seg]] + off, rows[lead[seg]], docs[lead[seg]], group))
        start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        many = np.add.reduceat(times[seg][order], start) > 1 if len(start) else np.zeros(0, bool)
        later = np.empty(len(seg), np.int8)
        later[order] = np.repeat(np.where(many, 2, 0), np.diff(np.r_[start, len(order)]))
        at_first = later.copy()
        at_first[order[start[many]]] = 1
        found = []
        for state, own in ((at_first, True), (later, False)):
            cut = np.flatnonzero(np.r_[True, (state[1:] != state[:-1]) | (seg[1:] != seg[:-1])]) if len(state) else np.zeros(0, np.int64)
            length = np.diff(np.r_[cut, len(state)])
            keep = state[cut] > 0
            cut, length = cut[keep], length[keep]
            of = np.ones(len(cut), np.int64) if own else times[seg[cut]] - 1
            run_of = np.repeat(np.arange(len(cut)), of)
            o = lead[seg[cut]][run_of] + (not own) + np.arange(len(run_of)) - np.repeat(np.cumsum(of) - of, of)
            cut, length = cut[run_of], length[run_of]
            found.append((chunk[o], rows[o], docs[o], begins[o] + off[cut], length, state[cut] == 2))
        cols = [np.concatenate(x) for x in zip(*found)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds)], names=["_chunk", "row", "doc_id", "begin", "windows", "later"])

    return run


def _join_up(window: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Spans of one chunk's documents from the runs of repeated windows."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        row, begin, n, later = (t[c].to_numpy() for c in ("row", "begin", "windows", "later"))
        ids = t["doc_id"].to_numpy()
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, np.int64)
        out: list[list] = [[], [], [], []]
        for a, b in zip(edge[:-1], edge[1:]):
            base = int(begin[a:b].min())
            end = begin[a:b] + n[a:b] + window - 1
            state = np.zeros(int(end.max()) - base, np.int8)
            for v in (False, True):
                for x, y in zip(begin[a:b][later[a:b] == v].tolist(), end[later[a:b] == v].tolist()):
                    state[x - base : y - base] = 2 if v else 1
            start = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
            stop = np.r_[start[1:], len(state)]
            keep = state[start] > 0
            for o, x in zip(out, (np.full(int(keep.sum()), ids[a]), start[keep] + base, stop[keep] + base, state[start][keep] == 2)):
                o.append(x)
        doc, x, y, z = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
        return pa.table([pa.array(doc.astype(np.int64), mask=doc == _NO_ID), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(z.astype(bool))], names=["doc_id", "start_word", "end_word", "removable"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int | None = None) -> DataFrame:
    """Maximal runs of words that lie in passages of `window` words or more which
    occur twice or more in docs: (doc_id, start_word, end_word, removable).

    end_word is exclusive.  removable is true where each word lies in a window
    that also begins earlier in the order of (doc_id, text, position), and
    false in first occurrences.

    docs needs doc_id (an integer) and text; other columns are ignored.  Null
    and empty texts and those shorter than `window` words give no rows.  Texts
    are used whole, however long.  Rows of a null doc_id come last in the order
    and keep the null.  Repeated rows are occurrences like any other.  An empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks, shards = layout(text_bytes(docs), chunk_bytes)
    base = chunked(docs, chunks)
    hot = base.groupBy("_chunk").applyInArrow(_send(window, anchor, shards), _SENT).groupBy("shard").applyInArrow(_repeated, _HOT)
    parts = base.groupBy("_chunk").cogroup(hot.groupBy("_chunk")).applyInArrow(_segments(window, anchor, chunks), _SEGMENTS)
    runs = parts.groupBy("block").applyInArrow(_block(window), _FOUND)
    return runs.groupBy("_chunk").applyInArrow(_join_up(window), "doc_id long, start_word long, end_word long, removable boolean")

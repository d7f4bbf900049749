"""Language-model scoring: interpolated modified Kneser-Ney n-grams.

Counting runs in Spark.  Tasks count the n-grams of their rows and send them,
packed, to shards by their last words; so a shard, which adds them up, also knows
how many different words precede those, which are their counts one level below.
It writes both as arrays sorted by hash to the shared folder, and sends on, by hash,
what it knows of each context and, for trigrams, of single words.  A second
pass adds that up and lays it beside the counts.  Scoring tasks memory-map the
arrays and look up each n-gram of a text once, in sorted runs.  Nothing is
pruned, and only a few totals of each shard reach the driver.

What is sent is coded by a dictionary of its own words, so that a trigram takes
about seven bytes.  The arrays hold three bytes of a hash besides what their place
tells; the few stored n-grams that these don't tell apart are listed in full.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import qualified, ready_to_checkpoint, scratch, text_bytes

U64 = np.uint64
#: n of the n-grams.
ORDER = 3
#: Words that a counting task holds before it packs and sends their n-grams.
FLUSH = 6_000_000
#: Words that a scoring task looks up together.
LOOKUP = 500_000
#: A shard takes this many bytes of text times the fourth root of all the text's bytes.
SHARD_SHARE = 210_000
#: Entries of a bucket of a stored array, about.
BUCKET = 16
#: Words are known by the upper 48 bits of their hash.
_WORD = U64(0xFFFFFFFFFFFF0000)
_BOS, _EOS = (int(tx.mix(np.array([k], U64), 99)[0] & _WORD) for k in (1, 2))
_PRESS = pa.Codec("zstd", compression_level=3)

_BLOBS = "level int, shard int, body binary"
_NAMES = ("level", "shard", "body")
_TYPES = (pa.int32(), pa.int32(), pa.binary())


def _hash(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Hash of the words' sequence, of so many upper bits."""
    h = np.full(len(words[0]), U64(len(words)))
    for w in words:
        h = tx.mix(h ^ w, 50)
    return h & U64((1 << 64) - (1 << (64 - bits)))


def _key(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams of the highest order, and the hashes that choose their
    shards: those of the last n - 1 words, so that a shard holds all n-grams that end alike."""
    if len(words) == 1:
        h = _hash(words, bits)
        return h, h
    end = _hash(words[1:], bits)
    return tx.mix(end ^ tx.mix(words[0], 51), 52), end


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> U64(40)) * U64(shards)) >> U64(24)).astype(np.int64)


def _range(shard: int, shards: int) -> tuple[int, int]:
    """The least hash of a shard, and how many hashes it spans."""
    a, b = (-(-(k << 24) // shards) for k in (shard, shard + 1))
    return a << 40, (b - a) << 40


def shard_count(size: int) -> int:
    """Shards for a corpus of so many bytes.  They grow in number and size, so that
    what a task sends to a shard stays worth a piece of its own."""
    return max(1, min(1 << 24, round(max(size, 1) ** 0.75 / SHARD_SHARE)))


def hash_bits(size: int) -> int:
    """Bits that tell the n-grams of a corpus of so many bytes apart, but for about one in 2^28."""
    return min(64, 22 + max(size, 1 << 10).bit_length())


# what is sent


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers of 0 or more by planes of their bytes, compressed."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T).tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + (_PRESS.compress(raw, asbytes=True) if raw else b"")


def _expand(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(_PRESS.decompress(b[9:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that are equal in all columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rank(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One number for each row, in the order of the rows; the columns have `bits` bits."""
    key, width = columns[0].astype(U64), bits
    for c in columns[1:]:
        if width + bits > 64:
            key = np.unique(key, return_inverse=True)[1].astype(U64)
            width = max(1, int(len(key)).bit_length())
        key = (key << U64(bits)) | c.astype(U64)
        width += bits
    return key


def _summed(columns: list[np.ndarray], values: list[np.ndarray], words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The different rows of columns (numbers of words) in order, and the sums of their values."""
    key = _rank(columns, max(1, int(words).bit_length()))
    order = np.argsort(key)
    start = _starts(key[order])
    at = order[start]
    return [c[at] for c in columns], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def _pack(columns: list[np.ndarray], words: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Rows of numbers of words, their values, and the words themselves.  Frequent
    words get small numbers; rows go by number, as differences from the row before."""
    times = np.bincount(np.concatenate(columns), minlength=len(words))
    used = np.flatnonzero(times)
    group = np.frexp(times[used])[1]
    used = used[np.lexsort((words[used], -group))]
    group = np.frexp(times[used])[1]
    local = np.zeros(len(words), np.int64)
    local[used] = np.arange(len(used))
    columns = [local[c] for c in columns]
    order = np.argsort(_rank(columns, max(1, len(used).bit_length())))
    columns = [c[order] for c in columns]
    cut = np.r_[_starts(group), len(used)]
    parts = [np.diff(cut).astype("<u4").tobytes(), *(tx.put_sorted(words[used[a:b]] >> U64(16)) for a, b in zip(cut[:-1], cut[1:]))]
    head = len(parts)
    start = np.zeros(1, np.int64) if len(order) else np.zeros(0, np.int64)
    for k, c in enumerate(columns):
        d = np.diff(c, prepend=0)
        d[start] = c[start]
        parts.append(_squeeze(d))
        start = _starts(*columns[: k + 1])
    parts += [_squeeze(v[order]) for v in values]
    sizes = np.array([head, *map(len, parts)], "<u4")
    return len(sizes).to_bytes(4, "little") + sizes.tobytes() + b"".join(parts)


def _unpack(b: bytes, n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """What _pack() got: n columns, words, values."""
    k = int.from_bytes(b[:4], "little")
    head, *sizes = np.frombuffer(b[4 : 4 + 4 * k], "<u4").tolist()
    cut = np.r_[0, np.cumsum(sizes)] + 4 + 4 * k
    parts = [b[i:j] for i, j in zip(cut[:-1], cut[1:])]
    words = np.concatenate([tx.get_sorted(p) for p in parts[1:head]] or [np.zeros(0, U64)]) << U64(16)
    columns: list[np.ndarray] = []
    start = np.zeros(1, np.int64)
    for p in parts[head : head + n]:
        d = _expand(p)
        s = np.cumsum(d)
        if len(d):
            s -= np.repeat(s[start] - d[start], np.diff(np.r_[start, len(d)]))
        columns.append(s.astype(np.int32))
        start = _starts(*columns)
    return columns, words, [_expand(p) for p in parts[head + n :]]


def _gathered(bodies: list[bytes], n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """All that was sent, summed: columns, words, values."""
    got = [_unpack(b, n) for b in bodies]
    words, number = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
    number = number.astype(np.int32)
    base = np.cumsum([0, *(len(g[1]) for g in got)])
    columns = [np.concatenate([number[g[0][k] + a] for g, a in zip(got, base)]) for k in range(n)]
    values = [np.concatenate(v) for v in zip(*(g[2] for g in got))]
    del got
    columns, values = _summed(columns, values, len(words))
    return columns, words, values


def _pack_sums(h: np.ndarray, values: list[np.ndarray], bits: int) -> bytes:
    """Sorted hashes and what goes with them."""
    parts = [tx.put_sorted(h >> U64(64 - bits)), *map(_squeeze, values)]
    sizes = np.array(list(map(len, parts)), "<u4")
    return len(sizes).to_bytes(4, "little") + sizes.tobytes() + b"".join(parts)


def _summed_by_hash(bodies: list[bytes], bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All that _pack_sums() sent, summed: different hashes in order, values."""
    got: list[list] = []
    for b in bodies:
        k = int.from_bytes(b[:4], "little")
        cut = np.r_[0, np.cumsum(np.frombuffer(b[4 : 4 + 4 * k], "<u4"))] + 4 + 4 * k
        parts = [b[i:j] for i, j in zip(cut[:-1], cut[1:])]
        got.append([tx.get_sorted(parts[0]) << U64(64 - bits), *map(_expand, parts[1:])])
    return _sums(*map(np.concatenate, zip(*got)))


def _sums(h: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(h)
    h = h[order]
    start = _starts(h)
    return h[start], [np.add.reduceat(v[order], start) if len(start) else v for v in values]


def _sent_sums(level: int, shards: int, bits: int, h: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    s = _shard(h, shards)
    cut = np.r_[_starts(s), len(s)]
    for a, b in zip(cut[:-1], cut[1:]):
        yield level, int(s[a]), _pack_sums(h[a:b], [v[a:b] for v in values], bits)


def _sent(level: int, shards: int, by: np.ndarray, columns: list[np.ndarray], words: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    s = _shard(by, shards)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        at = order[cut[k] : cut[k + 1]]
        yield level, k, _pack([c[at] for c in columns], words, [v[at] for v in values])


def sequences(text: pa.Array | pa.ChunkedArray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """For each piece: words with order - 1 opening marks before each row and a
    closing mark after it, the rows' firsts, the number of the first row and
    the rows' word counts.  Rows without words are empty."""
    for w in tx.words(text):
        n = np.diff(w.first)
        size = np.where(n > 0, n + order, 0)
        first = np.r_[0, np.cumsum(size)]
        seq = np.full(int(first[-1]), U64(_BOS))
        row = w.row_of_word()
        seq[np.arange(len(w)) - w.first[row] + first[row] + order - 1] = w.hash & _WORD
        seq[first[1:][n > 0] - 1] = U64(_EOS)
        yield seq, first, w.row0, n


def _ends(first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last words of the n-grams of all rows, and their rows."""
    size = np.maximum(np.diff(first) - order + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[:-1][row] + order - 1, row


def _count(order: int, shards: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            words, number = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
            number = number.astype(np.int32)
            base = np.cumsum([0, *(len(s) for s, _ in held)])
            end = np.concatenate([e + a for (_, e), a in zip(held, base)])
            held.clear()
            columns = [number[end - k] for k in (*range(order - 2, -1, -1), order - 1)]  # the first word last
            columns, values = _summed(columns, [np.ones(len(end), np.int32)], len(words))
            by = _hash([words[c] for c in columns[: max(1, order - 1)]], bits)
            for row in _sent(order, shards, by, columns, words, values):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=list(_NAMES))

        size = 0
        for b in batches:
            for seq, first, _, _ in sequences(b.column(0), order):
                end, _ = _ends(first, order)
                if len(end):
                    held.append((seq, end))
                    size += len(seq)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
        tx.release()

    return run


# what is stored


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """folder is a full address, as qualified() gives it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    for alias in ("s3a:", "s3n:"):
        if folder.startswith(alias):
            folder = "s3:" + folder.removeprefix(alias)
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """A file appears whole or not at all, and a repeated task writes the same again."""
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    with where.open_output_stream(draft) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    where.move(draft, f"{path}/{name}")


def _map(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file: memory-mapped where the folder is a mounted one, else read."""
    where, path = _open(folder)
    if isinstance(where, fs.LocalFileSystem):
        if not os.path.exists(f"{path}/{name}"):
            return []
        raw = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        if where.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return []
        with where.open_input_file(f"{path}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = []
    for kind, n in json.loads(raw[8:at].tobytes()):
        size = n * np.dtype(kind).itemsize
        out.append(np.ndarray((n,), kind, raw, offset=at))
        at += size
    return out


def _coded(values: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of counts as one byte each, or half a one if there is one count a row:
    its number among the most frequent ones, or a last number and a place in a list."""
    n, k = len(values[0]), len(values)
    none = 15 if k == 1 else 255
    bits = 12 if k == 1 else 5  # of a count that may have a number
    small = np.ones(n, bool)
    packed = np.zeros(n, np.int64)
    for v in values:
        small &= v < 1 << bits
        packed = packed << bits | v
    times = np.bincount(packed[small], minlength=1 << (bits * k))
    best = np.argsort(-times, kind="stable")[:none]
    best = best[times[best] > 0]
    code = np.full(len(times), none, np.uint8)
    code[best] = np.arange(len(best))
    out = np.full(n, none, np.uint8)
    out[small] = code[packed[small]]
    rest = np.flatnonzero(out == none)
    if none == 15:
        pair = np.append(out, np.zeros(n % 2, np.uint8))
        out = pair[::2] | (pair[1::2] << 4)
    common = [best >> (bits * (k - 1 - c)) & ((1 << bits) - 1) for c in range(k)]
    return [out, rest.astype(np.uint32 if n < 1 << 32 else np.uint64), *common, *(v[rest].astype(np.int64) for v in values)]


class _Values:
    """Reads what _coded() made."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.code, self.rest = arrays[:2]
        n = (len(arrays) - 2) // 2
        self.none = 15 if n == 1 else 255
        self.common = [np.append(a, [0] * (256 - len(a))) for a in arrays[2 : 2 + n]]
        self.rare = arrays[2 + n :]

    def at(self, place: np.ndarray) -> list[np.ndarray]:
        if self.none == 15:
            code = (self.code[place >> 1] >> (4 * (place & 1)).astype(np.uint8)) & np.uint8(15)
        else:
            code = self.code[place]
        out = [c[code] for c in self.common]
        far = np.flatnonzero(code == self.none)
        if len(far):
            k = np.searchsorted(self.rest, place[far].astype(self.rest.dtype))
            for o, r in zip(out, self.rare):
                o[far] = r[k]
        return out


def _keyed(keys: np.ndarray, low: int, span: int) -> list[np.ndarray]:
    """Sorted hashes, `span` from `low` on, as buckets' bounds, three bytes of
    each, and in full those that these don't tell apart."""
    shift = min(63, max(24, (span - 1).bit_length() - (len(keys) // BUCKET).bit_length()))
    x = keys - U64(low)
    bucket, part = x >> U64(shift), ((x >> U64(shift - 24)) & U64(0xFFFFFF)).astype("<u4")
    bounds = np.searchsorted(bucket, np.arange(((span - 1) >> shift) + 2, dtype=U64)).astype(np.uint32 if len(keys) < 1 << 32 else np.uint64)
    three = np.zeros(3 * len(keys) + 1, np.uint8)
    three[:-1] = part.view(np.uint8).reshape(-1, 4)[:, :3].ravel()
    same = (bucket[1:] == bucket[:-1]) & (part[1:] == part[:-1])
    twin = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    return [np.array([low, shift], U64), bounds, three, keys[twin], twin.astype(np.uint64)]


class _Keys:
    """Finds hashes in what _keyed() made."""

    SIZE = 5

    def __init__(self, arrays: list[np.ndarray]) -> None:
        (self.low, self.shift), self.bounds, three, self.twins, self.twin_at = arrays
        self.n = (len(three) - 1) // 3
        self.part = np.ndarray((self.n,), "<u4", np.asarray(three), strides=(3,))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where there is none.  A key that isn't stored is
        taken for one in about a million times."""
        x = keys - self.low
        bucket = (x >> self.shift).astype(np.int64)
        want = ((x >> (self.shift - U64(24))) & U64(0xFFFFFF)).astype(np.uint32)
        a, b = self.bounds[bucket].astype(np.int64), self.bounds[bucket + 1].astype(np.int64)
        end = b.copy()
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            mid = np.minimum((a + b) >> 1, self.n - 1)
            less = ((self.part[mid] & np.uint32(0xFFFFFF)) < want) & (a < b)
            a, b = np.where(less, mid + 1, a), np.where(less, b, np.minimum(mid, b))
        hit = a < end
        hit[hit] = (self.part[a[hit]] & np.uint32(0xFFFFFF)) == want[hit]
        out = np.where(hit, a, -1)
        if len(self.twins):
            k = np.minimum(np.searchsorted(self.twins, keys), len(self.twins) - 1)
            own = self.twins[k] == keys
            out[own] = self.twin_at[k[own]].astype(np.int64)
        return out


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return tuple(x[order] for x in (keys, *values))


def _followers(c: np.ndarray) -> list[np.ndarray]:
    return [(c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64)]


def _stats(level: int, shard: int, count: np.ndarray) -> tuple[int, int, bytes]:
    said = {"level": level, "n": [int((count == n).sum()) for n in (1, 2, 3, 4)], "total": int(count.sum()), "types": int((count > 0).sum())}
    return 0, shard, json.dumps(said).encode()


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(cols, _TYPES)], names=list(_NAMES))


def _merge(order: int, shards: int, bits: int, folder: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adds up one shard of n-grams, writes their counts and those of their ends,
    and sends on the sums by context and by single word."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        columns, words, (count,) = _gathered(t["body"].to_pylist(), order)
        grams = [words[c] for c in (*columns[-1:], *columns[:-1])]
        keys, c = _by_key(_key(grams, bits)[0], count)
        here = _range(shard, shards)
        _write(folder, f"grams-{shard}", [*_keyed(keys, *(here if order == 1 else (0, 1 << 64))), *_coded([c])])
        rows = [_stats(order, shard, count)]
        if order > 1:
            h, sums = _sums(_hash(grams[:-1], bits), count, *_followers(count))
            rows += _sent_sums(order - 1, shards, bits, h, sums)
            start = _starts(*columns[:-1])
            c = np.diff(np.r_[start, len(count)])
            rows.append(_stats(order - 1, shard, c))
            h = _hash([g[start] for g in grams[1:]], bits)
            if order > 2:
                before, last = columns[0][start], columns[1][start]
                n = len(words)
                sums = [np.bincount(last, minlength=n), np.bincount(before, c, n).astype(np.int64), *(np.bincount(before[f > 0], minlength=n) for f in _followers(c))]
                some = np.flatnonzero(sums[0] + sums[1])
                one, *sums = _by_key(_hash([words[some]], bits), *(x[some] for x in sums))
                rows += _sent_sums(1, shards, bits, one, sums)
            keys, c = _by_key(h, c)
            _write(folder, f"ends-{shard}", [*_keyed(keys, *here), *_coded([c])])
        del columns, words, count, grams, keys, c
        tx.release()
        return _rows(rows)

    return run


def _merge_sums(order: int, shards: int, bits: int, folder: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adds up what one shard's n-grams are as contexts, and its single words."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        levels, bodies = t["level"].to_pylist(), t["body"].to_pylist()
        here = _range(shard, shards)
        rows = [(0, shard, b) for x, b in zip(levels, bodies) if x == 0]
        if order > 1 and (some := [b for x, b in zip(levels, bodies) if x == order - 1]):
            h, sums = _summed_by_hash(some, bits)
            ends = _map(folder, f"ends-{shard}")
            place = _Keys(ends[: _Keys.SIZE]).find(h) if ends else np.full(len(h), -1)
            if ends:
                beside = [np.zeros(_Keys(ends[: _Keys.SIZE]).n, np.int64) for _ in sums]
                for b, v in zip(beside, sums):
                    b[place[place >= 0]] = v[place >= 0]
                _write(folder, f"contexts-{shard}", _coded(beside))
            own = place < 0
            _write(folder, f"starts-{shard}", [*_keyed(h[own], *here), *_coded([v[own] for v in sums])])
        if order > 2 and (some := [b for x, b in zip(levels, bodies) if x == 1]):
            h, sums = _summed_by_hash(some, bits)
            _write(folder, f"words-{shard}", [*_keyed(h, *here), *_coded(sums[:1]), *_coded(sums[1:])])
            rows.append(_stats(1, shard, sums[0]))
        return _rows(rows)

    return run


@dataclass
class Model:
    """Where the arrays are, and what holds for all of a level."""

    folder: str
    order: int
    shards: int
    discounts: list[tuple[float, float, float]]  # by level, 1 first
    total: int  # of level 1
    types: int
    followers: tuple[int, int, int]
    bits: int


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; where the
    counts of counts don't allow an estimate, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(d) if all(0 < x < k + 1 for k, x in enumerate(d)) else (0.5, 1.0, 1.5)


def train(docs: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """Counts all n-grams of docs.text in words, an opening and a closing mark
    included, and stores them in the shared folder.  Texts without words count nothing."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    size = text_bytes(docs)
    shards, bits = shards or shard_count(size), hash_bits(size)
    folder = qualified(spark, scratch(spark, "ngrams"))
    rows = docs.select("text").mapInArrow(_count(order, shards, bits), _BLOBS)
    rows = rows.groupBy("shard").applyInArrow(_merge(order, shards, bits, folder), _BLOBS)
    rows = rows.groupBy("shard").applyInArrow(_merge_sums(order, shards, bits, folder), _BLOBS)
    stats = [json.loads(bytes(r["body"])) for r in rows.where("level = 0").select("body").collect()]
    of = lambda x: [s for s in stats if s["level"] == x]
    found = [discounts(*(sum(s["n"][k] for s in of(level)) for k in range(4))) for level in range(1, order + 1)]
    low = of(1)
    once, twice = (sum(s["n"][k] for s in low) for k in (0, 1))
    types = sum(s["types"] for s in low)
    return Model(folder, order, shards, found, sum(s["total"] for s in low), types, (once, twice, types - once - twice), bits)


class Scorer:
    """Looks n-grams up in the stored arrays."""

    def __init__(self, model: Model) -> None:
        self.m = model
        mounted = isinstance(_open(model.folder)[0], fs.LocalFileSystem)
        # maps cost next to nothing; what had to be read is dropped when the next shard is
        self.shard = lru_cache(maxsize=1024 if mounted else 1)(self._shard)

    def _shard(self, level: int, shard: int) -> tuple[list, ...]:
        """(keys, values) pairs, or (keys, values, values): counts, then totals and followers as a context."""
        get = lambda name: _map(self.m.folder, f"{name}-{shard}")
        k = _Keys.SIZE
        if level == self.m.order:
            a = get("grams")
            return ((_Keys(a[:k]), _Values(a[k:]), None),) if a else ()
        if level < self.m.order - 1:
            a = get("words")
            return ((_Keys(a[:k]), _Values(a[k : k + 4]), _Values(a[k + 4 :])),) if a else ()
        out = []
        if a := get("ends"):
            c = get("contexts")
            out.append((_Keys(a[:k]), _Values(a[k:]), _Values(c) if c else None))
        if a := get("starts"):
            out.append((_Keys(a[:k]), None, _Values(a[k:])))
        return tuple(out)

    def look(self, words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Counts of n-grams, and as contexts their totals and how many followers
        counted once, twice and more; zeros where there is none."""
        level = len(words)
        keys, by = _key(words, self.m.bits) if level == self.m.order else [_hash(words, self.m.bits)] * 2
        # by shard, and near each other in it; an n-gram that stands apart from its like is looked up again
        order = np.argsort(keys if by is keys else (by & U64(0xFFFFFF << 40)) | (keys >> U64(24)))
        ordered = keys[order]
        start = _starts(ordered)
        different = ordered[start]
        s = _shard(by[order[start]], self.m.shards)
        got = np.zeros((1 if level == self.m.order else 5, len(different)), np.int64)
        cut = np.r_[_starts(s), len(s)]
        for a, b in zip(cut[:-1], cut[1:]):
            for table, count, context in self.shard(level, int(s[a])):
                place = table.find(different[a:b])
                hit = np.flatnonzero(place >= 0)
                for values, where in ((count, got[:1]), (context, got[1:])):
                    if values is not None:
                        where[:, a + hit] = values.at(place[hit])
        times = np.diff(np.r_[start, len(keys)])
        out = []
        for g in got:
            out.append(np.empty(len(keys), np.int64))
            out[-1][order] = np.repeat(g, times)
        return out[0], out[1:]

    def lowest(self, c: np.ndarray) -> np.ndarray:
        """P(word) from the word's count at level 1."""
        total = max(self.m.total, 1)
        rest = sum(d * n for d, n in zip(self.m.discounts[0], self.m.followers)) / total if self.m.total else 1.0
        return (c - self._discount(1, c)) / total + rest / (self.m.types + 1)

    def _discount(self, level: int, c: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.m.discounts[level - 1]])[np.minimum(c, 3)]

    def higher(self, level: int, c: np.ndarray, context: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """P at a level from the n-gram's count, its context's counts and P at the level below."""
        total, *n = context
        seen = total > 0
        rest = np.divide(sum(x * k for x, k in zip(self.m.discounts[level - 1], n)), total, out=np.ones(len(c)), where=seen)
        own = np.divide(c - self._discount(level, c), total, out=np.zeros(len(c)), where=seen)
        return own + rest * lower

    def probability(self, words: list[np.ndarray]) -> np.ndarray:
        """P(last word | the words before it)."""
        c, _ = self.look(words)
        if len(words) == 1:
            return self.lowest(c)
        return self.higher(len(words), c, self.look(words[:-1])[1], self.probability(words[1:]))

    def along(self, seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P of the last words of all n-grams of the rows, and the rows; each
        shorter n-gram is looked up once, as the end of one and the context of the next."""
        order = self.m.order
        end, row = _ends(first, order)
        p, context = np.zeros(0), np.zeros((4, 0), np.int64)
        for level in range(1, order + 1):
            at, _ = _ends(first, level)
            c, mine = self.look([seq[at - k] for k in range(level - 1, -1, -1)])
            place = np.zeros(len(seq), np.int64)  # where an n-gram of this level ends
            place[at] = np.arange(len(at))
            here = c[place[end]]
            if level == 1:
                p = self.lowest(here)
            else:
                p = self.higher(level, here, [x[before] for x in context], p)
            if level < order:
                before, context = place[end - 1], mine
        return p, row


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            logs, words = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            held: list[tuple] = []

            def flush() -> None:
                seq, base = np.concatenate([h[0] for h in held]), np.cumsum([0, *(len(h[0]) for h in held)])  # noqa: B023
                first = np.concatenate([h[1][:-1] + a for h, a in zip(held, base)] + [base[-1:]])  # noqa: B023
                p, row = scorer.along(seq, first)
                rows = np.concatenate([h[2] + np.arange(len(h[3])) for h in held])  # noqa: B023
                logs[rows] = np.bincount(row, np.log(p), len(rows))  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for piece in sequences(b.column(1), model.order):
                words[piece[2] + np.arange(len(piece[3]))] = piece[3]
                if len(piece[0]):
                    held.append(piece)
                    size += len(piece[0])
                if size >= LOOKUP:
                    flush()
                    size = 0
            if held:
                flush()
            some = words > 0
            mean = np.divide(logs, words + 1, out=np.zeros(len(logs)), where=some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(np.round(logs, 4), mask=~some), pa.array(np.round(np.exp(-mean), 4), mask=~some)], names=["doc_id", "n_words", "log_prob", "perplexity"])
        tx.release()

    return run


def perplexity(docs: DataFrame, model: Model | None = None, order: int = ORDER) -> DataFrame:
    """Each row's log probability (natural) and perplexity under an interpolated
    modified Kneser-Ney model: (doc_id, n_words, log_prob, perplexity).

    The model is trained on docs unless one is given; it counts every n-gram of
    every row.  Perplexity is taken over a text's words and its closing mark.
    A word never counted has the uniform share of the discounted mass.

    Null, empty and blank texts have no words, count nothing and get nulls.
    Null doc_ids stay; repeated rows are counted each and get equal results;
    texts are counted and scored whole; other columns are ignored; an empty
    table gives an empty result.
    """
    model = train(docs, order) if model is None else model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, n_words long, log_prob double, perplexity double")

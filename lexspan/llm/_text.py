"""Vectorised tokenising and hashing over Arrow string columns.

Everything here works on the UTF-8 buffer of a whole batch with numpy: no
Python loop runs per word.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = b" \t\n\r\x0b\x0c"
_PAD = 16
_PRESS = pa.Codec("zstd", compression_level=1)
_LONG_WORD = 256

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE)] = False
_MASK = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _TRIM = None


def release() -> None:
    """Gives memory that isn't used any more back to the system: workers are
    kept for later tasks and would hold it for as long."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); salt selects another one."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of some consecutive rows; word i spans data[start[i]:end[i]]."""

    data: np.ndarray  # padded bytes of the rows
    bounds: np.ndarray  # byte offsets of the rows, one more than rows
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of the first word of each row, one more than rows
    hash: np.ndarray
    row0: int  # number of the first row in the whole column

    def __len__(self) -> int:
        return len(self.start)

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows that hold about `size` bytes each, and `rows` rows at most."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n, i + (rows or n))
        yield i, j
        i = j


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of `data`, which has 8 spare bytes at its end."""
    size = end - start
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) << U64(56)))
    rest = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    k = 8
    while len(rest):
        s = size[rest] - k
        h[rest] = mix(h[rest] ^ (eight[start[rest] + k] & _MASK[np.minimum(s, 8)]), 1)
        rest, k = rest[s > 8], k + 8
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def spans(is_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true that don't cross row bounds."""
    n = int(bounds[-1])
    w = is_word[:n]
    before = np.empty(n, bool)
    before[1:] = w[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    before[inner] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[:-1] = w[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    after[last] = False
    return start, np.flatnonzero(w & ~after) + 1


def words(col: pa.Array | pa.ChunkedArray, size: int = 1 << 20, lower: bool = False) -> Iterator[Words]:
    """Words (runs of bytes other than ASCII white space) of all rows, in pieces
    of whole rows of about `size` bytes, small enough for the processor's cache."""
    data, offs = string_buffers(col)
    for i, j in slices(offs, size):
        part = np.zeros(int(offs[j] - offs[i]) + _PAD, np.uint8)
        raw = data[offs[i] : offs[j]]
        part[: len(raw)] = _LOWER[raw] if lower else raw
        bounds = offs[i : j + 1] - offs[i]
        start, end = spans(_IS_WORD[part[: len(raw)]], bounds)
        yield Words(part, bounds, start, end, np.searchsorted(start, bounds), word_hash(part, start, end), i)


_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, U64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each n consecutive values of h; equal runs get equal hashes
    wherever they stand.  `which` chooses one of two independent hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    p, inv = _powers(which, 1 << max(10, int(len(h)).bit_length()))
    s = np.zeros(len(h) + 1, U64)
    src = h if which == 0 else mix(h, 7)
    np.cumsum(src * p[: len(h)], out=s[1:])
    return mix((s[n:] - s[:-n]) * inv[:m], 2 + which)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words, and rows, of all windows of n words that lie in one row."""
    count = np.maximum(np.diff(w.first) - n + 1, 0)
    total = int(count.sum())
    row = np.repeat(np.arange(w.rows), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][row]
    return at, row


def chars_before(data: np.ndarray, n: int) -> np.ndarray:
    """For each byte offset up to n, the characters that begin before it."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum((data[:n] & 0xC0) != 0x80, out=out[1:])
    return out


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array by significance; all but the lowest, which are hard to press, are compressed."""
    cols = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    low, rest = cols[0].tobytes(), cols[1:].tobytes()
    packed = _PRESS.compress(rest, asbytes=True) if rest else b""
    return len(x).to_bytes(8, "little") + low + packed


def from_planes(b: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(b[:8], "little")
    rest = _PRESS.decompress(b[8 + n :], n * (size - 1), asbytes=True) if size > 1 and n else b""
    return np.ascontiguousarray(np.frombuffer(b[8 : 8 + n] + rest, np.uint8).reshape(size, n).T).view(kind).ravel()


def put_sorted(x: np.ndarray) -> bytes:
    """Packs sorted unsigned integers as differences, in the fewest bytes that hold them."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=x[:1])
    d[0] = 0
    top = int(d.max())
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k))
    return bytes([kind]) + int(x[0]).to_bytes(8, "little") + planes(d.astype(f"<u{kind}"))


def get_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, U64)
    d = from_planes(b[9:], np.dtype(f"<u{b[0]}")).astype(U64)
    d[0] = int.from_bytes(b[1:9], "little")
    return np.cumsum(d)

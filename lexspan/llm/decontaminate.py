"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders.
Windows of a few template tokens are hash-joined with the benchmark's, and the
values in the placeholders must then agree: within an occurrence of an item, each
value of the item must stand for one value of the document.  That catches
questions that were copied with other numbers or names, and rejects windows that are
alike by chance.  Windows with too few words for that, and short items, are joined as they stand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import free_name, ready_to_checkpoint

U64 = np.uint64
WINDOW = 8
#: Template tokens of a window that must be words.
MIN_LITERALS = 3
#: Items of fewer tokens are only looked for as they stand.
MIN_ITEM = 5
#: A document leaks an item if it covers this share of the item's tokens, or this many.
MIN_SHARE = 0.5
MIN_TOKENS = 20

#: Bytes that a row of a broadcast table takes in memory, about.
ROW_BYTES = 200

NUMBER, NAME, UNIT = 1, 2, 3
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "cent cents dollar dollars usd euro euros eur percent degree degrees celsius fahrenheit kph mph watt watts kw kwh volt volts joule joules byte bytes kb mb gb tb"
).split()

#: Spelled-out numbers; "one" is a word, as it mostly stands for something else.
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_WORD = np.zeros(256, np.uint8)
_WORD[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_WORD[48:58] = 2
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True


def _hash_of(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    return tx.word_hash(np.frombuffer(data + bytes(16), np.uint8), ends - np.array([len(w.encode()) for w in words]), ends)


def _among(word: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word


def _is_unit(word: np.ndarray) -> np.ndarray:
    return _among(word, _UNIT_HASHES)


_UNIT_HASHES, _NUMBER_HASHES = np.sort(_hash_of(UNITS)), np.sort(_hash_of(NUMBER_WORDS))
_PLACE = tx.mix(np.arange(4, dtype=U64), 77)


def _sums(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How many of the n values from each place on are true."""
    c = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=c[1:])
    return c[at + n] - c[at]


class Template:
    """Template tokens of some rows: `key` are hashes of words or placeholders,
    `slot` the value in a placeholder with its type in the last two bits, else 0.

    A capitalised word that opens a sentence may be a name or not: it is a word in
    `key` and `slot`, and a name in `open_key` and `open_slot`."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray) -> None:
        n = len(raw)
        kind = _WORD[raw]
        joint = np.flatnonzero((raw == 46) | (raw == 44))  # . and , between digits belong to the number
        joint = joint[(joint > 0) & (joint < n - 1)]
        kind[joint[(kind[joint - 1] == 2) & (kind[joint + 1] == 2)]] = 2
        edge = np.ones(n + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[bounds] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        some = kind[start] > 0
        start, end = start[some], end[some]
        low = np.zeros(n + 16, np.uint8)
        low[:n] = tx._LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) if n else raw[:0]
        cap = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] <= 0x9E) & (raw[lead + 1] != 0x97)]
        low[cap + 1] += 0x20
        capital = (raw >= 65) & (raw <= 90)
        capital[cap] = True
        stops = np.zeros(n + 1, np.int64)
        np.cumsum(_STOP[raw], out=stops[1:])
        self.first = np.searchsorted(start, bounds)
        opens = np.ones(len(start), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        begins = self.first[:-1][np.diff(self.first) > 0]
        opens[begins] = True
        word = tx.word_hash(low, start, end)
        number = (kind[start] == 2) | _among(word, _NUMBER_HASHES)
        after_number = np.zeros(len(start), bool)
        after_number[1:] = number[:-1]
        after_number[begins] = False
        unit = np.zeros(len(start), bool)
        maybe = np.flatnonzero(after_number)
        unit[maybe] = _is_unit(word[maybe])
        name = capital[start] & ~opens & ~unit & ~number
        kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
        self.key = np.where(kinds > 0, _PLACE[kinds], word)
        self.slot = np.where(kinds > 0, (word & ~U64(3)) | kinds.astype(U64), U64(0))
        self.opener = capital[start] & opens & ~unit & ~number
        self.open_key = np.where(self.opener, _PLACE[NAME], self.key)
        self.open_slot = np.where(self.opener, (word & ~U64(3)) | U64(NAME), self.slot)
        self.word, self.number = word, number
        self.plain = ~number & ~capital[start] & ~_is_unit(word)  # words whatever stands before them
        self.rows = len(bounds) - 1

    def spots(self, n: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and rows of all windows."""
        have = np.diff(self.first)
        count = np.maximum(have - n + 1, 0)
        if rows is not None:
            count = np.where(rows, count, 0)
        row = np.repeat(np.arange(self.rows), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + self.first[:-1][row]
        return at, row

    def windows(self, n: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First tokens, rows, hashes and slots of the windows with enough words;
        those with openers come a second time, with these as names."""
        every, row = self.spots(n, rows)
        out = []
        for key, slot, some in ((self.key, self.slot, None), (self.open_key, self.open_slot, self.opener)):
            good = _sums(slot == 0, every, n) >= min(MIN_LITERALS, n)
            if some is not None:
                good &= _sums(some, every, n) > 0
            at = every[good]
            out.append((at, row[good], (tx.rolling(key, n)[at] ^ U64(n)) if len(at) else np.zeros(0, U64), np.full(len(at), some is not None)))
        return tuple(map(np.concatenate, zip(*out)))

    def verbatim(self, n: int, window: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First tokens, rows and hashes of the windows as they stand that have
        few plain words or fewer tokens than `window`; whether they are numbers
        only, and hashes that also tell whether numbers go on before or after."""
        at, row = self.spots(n, rows)
        if n == window:
            few = _sums(self.plain, at, n) < min(MIN_LITERALS, n)
            at, row = at[few], row[few]
        h = (tx.rolling(tx.mix(self.word, 78), n)[at] ^ U64(n)) if len(at) else np.zeros(0, U64)
        numbers = _sums(self.number, at, n) == n
        number = np.append(self.number, False)
        goes_on = (number[at - 1] & (at > self.first[row])) + 2 * (number[at + n] & (at + n < self.first[row + 1]))
        return at, row, h, numbers, tx.mix(h ^ goes_on.astype(U64), 79)

    def slots(self, at: np.ndarray, n: int, opened: np.ndarray, still: int) -> pa.Array:
        """Slots of windows, and zeros for the last `still` ones, which hold no placeholders."""
        where = at[:, None] + np.arange(n)[None, :]
        flat = np.where(opened[:, None], self.open_slot[where], self.slot[where]).astype(np.int64) if len(at) else np.zeros((0, n), np.int64)
        flat[len(at) - still :] = 0
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n, dtype=np.int32)), pa.array(flat.ravel()))


def templates(text: pa.Array | pa.ChunkedArray) -> Iterator[tuple[Template, int]]:
    data, offs = tx.string_buffers(text)
    for i, j in tx.slices(offs, 1 << 20):
        yield Template(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), i


def _item_windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of the items; an item shorter than the window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, i in templates(b.column(1)):
                size = np.diff(t.first)
                digits = np.concatenate(([0], np.cumsum(t.number)))
                digits = np.diff(digits[t.first]) == size
                for n in sorted({min(window, int(s)) for s in size if s}):
                    rows = (size >= window) if n == window else size == n
                    at, row, h, opened = t.windows(n, rows & (size >= MIN_ITEM))
                    at2, row2, h2, _, bounded = t.verbatim(n, window, rows)
                    at, row, h = np.concatenate((at, at2)), np.concatenate((row, row2)), np.concatenate((h, np.where(digits[row2], bounded, h2)))
                    opened = np.concatenate((opened, np.zeros(len(at2), bool)))
                    ids = b.column(0).take(pa.array(i + row))
                    cols = [pa.array(h.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), ids, pa.array((at - t.first[row]).astype(np.int32)), pa.array(size[row].astype(np.int32)), pa.array(digits[row]), t.slots(at, n, opened, len(at2))]
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "item_id", "item_at", "item_tokens", "item_numbers", "item_slots"])

    return run


def _doc_windows(lengths: list[int], window: int, known: dict[int, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of the documents, only those that the items have if these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {}
        for n, x in (known or {}).items():
            bits = max(16, len(x).bit_length() + 4)
            maps[n] = np.zeros(1 << bits, bool), 64 - bits
            maps[n][0][x >> U64(64 - bits)] = True
        for b in batches:
            for t, i in templates(b.column(1)):
                for n in lengths:
                    at, row, h, opened = t.windows(n, None if n >= min(MIN_ITEM, window) else np.zeros(t.rows, bool))
                    at2, row2, h2, numbers, bounded = t.verbatim(n, window)
                    still = np.concatenate((np.zeros(len(at), bool), np.ones(len(at2) + int(numbers.sum()), bool)))
                    at, row, h = np.concatenate((at, at2, at2[numbers])), np.concatenate((row, row2, row2[numbers])), np.concatenate((h, h2, bounded[numbers]))
                    opened = np.concatenate((opened, np.zeros(len(at) - len(opened), bool)))
                    if known is not None:
                        x, (seen, shift) = known[n], maps[n]
                        maybe = np.flatnonzero(seen[h >> U64(shift)])
                        hit = maybe[x[np.minimum(np.searchsorted(x, h[maybe]), len(x) - 1)] == h[maybe]]
                        at, row, h, opened, still = at[hit], row[hit], h[hit], opened[hit], still[hit]
                    if len(at):
                        where = pa.array(i + row)
                        cols = [pa.array(h.view(np.int64)), b.column(0).take(where), b.column(2).take(where), pa.array((at - t.first[row]).astype(np.int32)), t.slots(at, n, opened, int(still.sum()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["h", "doc_id", "th", "doc_at", "doc_slots"])

    return run


def agreement(windows: list[tuple[int, list[int], list[int]]]) -> tuple[int, bool]:
    """Tokens of an item that consistent windows cover, and whether a value differs.

    windows: the first token in the item, the item's slots, the document's.
    A value of the item stands for the document's value that it meets in most
    windows (of equal ones the least); a name of the document may stand for
    one of the item only.  Windows with another pair don't count, unless all
    their values are the item's own."""
    pairs: Counter = Counter()
    for _, mine, theirs in windows:
        pairs.update((a, b) for a, b in zip(mine, theirs) if a)
    best: dict[int, int] = {}
    taken: dict[int, int] = {}
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in best and (b & 3 != NAME or taken.get(b, a) == a):
            best[a] = b
            taken[b] = a
    covered: set[int] = set()
    other = False
    for at, mine, theirs in windows:
        differs = mine != theirs
        if not differs or all(best.get(a) == b for a, b in zip(mine, theirs) if a):
            covered.update(range(at, at + len(mine)))
            other |= differs
    return len(covered), other


def occurrences(windows: list[tuple[int, int, list[int], list[int]]], size: int) -> list[list[tuple[int, list[int], list[int]]]]:
    """The windows of an item of `size` tokens, given with their first tokens in
    the document and in the item, by occurrence: those of each distance between
    the two, chains that go on over words put in or left out, and all together."""
    straight: dict[int, list] = {}
    chains: list[list] = []
    ends: dict[int, tuple[int, int, list]] = {}  # by distance: the last window's first tokens, and the chain
    for there, at, mine, theirs in sorted(windows):
        straight.setdefault(there - at, []).append((at, mine, theirs))
        last = ends.pop(there - at, None)
        if last is None or there - last[0] > size:
            ends = {d: x for d, x in ends.items() if there - x[0] <= size}
            near = min((d for d, x in ends.items() if x[0] < there and x[1] < at), key=lambda d: abs(there - at - d), default=None)
            last = (there, at, []) if near is None else ends.pop(near)
            if near is None:
                chains.append(last[2])
        last[2].append((at, mine, theirs))
        ends[there - at] = there, at, last[2]
    every = [w for g in straight.values() for w in g]
    return [*straight.values(), *chains, every] if len(straight) > 1 else [every]


def _judge(share: float, tokens: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list] = {}
        for item, size, numbers, *window in zip(*(t[c].to_pylist() for c in ("item_id", "item_tokens", "item_numbers", "doc_at", "item_at", "item_slots", "doc_slots"))):
            by.setdefault((item, size, numbers), []).append(tuple(window))
        rows = []
        for (item, size, numbers), windows in by.items():
            got, other = max(map(agreement, occurrences(windows, size)), key=lambda x: (x[0], not x[1]))
            if got >= size if numbers else got >= share * size or got >= tokens:
                rows.append((key[0].as_py(), key[1].as_py(), item, got, size, other))
        cols = zip(*rows) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "th", "item_id", "covered", "item_tokens", "reparameterised"])

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, share: float, tokens: int, broadcast_bytes: int) -> DataFrame:
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.mapInArrow(_item_windows(window), "h long, n int, item_id long, item_at int, item_tokens int, item_numbers boolean, item_slots array<long>")
    size = {r["n"]: (r["c"], r["rows"]) for r in items.groupBy("n").agg(F.countDistinct("h").alias("c"), F.count("*").alias("rows")).collect()}
    known = None
    # many items may share a window, so what is broadcast is counted by rows
    small = F.broadcast if sum(rows for _, rows in size.values()) * ROW_BYTES <= broadcast_bytes else (lambda x: x)
    if sum(c for c, _ in size.values()) * ROW_BYTES <= broadcast_bytes:
        found = items.select("n", "h").distinct().toArrow()
        n, h = found["n"].to_numpy(), found["h"].to_numpy().view(U64)
        known = {int(k): np.sort(h[n == k]) for k in np.unique(n)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    met = rows.mapInArrow(_doc_windows(sorted(size), window, known), "h long, doc_id long, th long, doc_at int, doc_slots array<long>")
    return met.join(small(items), "h").groupBy("doc_id", "th").applyInArrow(_judge(share, tokens), "doc_id long, th long, item_id long, covered int, item_tokens int, reparameterised boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = MIN_SHARE, tokens: int = MIN_TOKENS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Documents that hold items of benchmark(item_id, text): (doc_id, item_id,
    covered, item_tokens, reparameterised), one row for each pair.

    A document leaks an item if windows of `window` template tokens, with
    consistent placeholders, cover `share` of the item's tokens or `tokens` of
    them.  Placeholders must be consistent within an occurrence of the item, not
    between several; the one that covers most counts.  reparameterised tells
    whether some number, name or unit differs there from the item's; it is
    false if an occurrence where none does covers as many.  Numbers are runs of
    digits (with . and , inside) and the words of NUMBER_WORDS, each by itself, names are
    words with a capital, and units are the words of UNITS after a number.  A word
    with a capital that opens a sentence is tried as a plain word and as a name.  Windows with
    fewer than MIN_LITERALS words, numbers, names and units aside, must be met
    as they stand but for case; so must items of fewer than MIN_ITEM tokens,
    and whole, as any of fewer than `window` must.  An item of nothing but numbers must be met
    whole, and not inside a longer run of numbers.

    Null and empty texts, of documents or items, and items of a null item_id
    match nothing.  Null doc_ids stay null, and all rows of a null doc_id and
    equal text are one document; so are repeated rows.  Items of equal text are
    found each.  Items that share an item_id and a length are one item, which any
    of their windows cover.
    Texts are read whole; other columns are ignored; an empty documents table
    or benchmark gives an empty result.
    """
    return _leaks(docs, benchmark, window, share, tokens, broadcast_bytes).drop("th").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = MIN_SHARE, tokens: int = MIN_TOKENS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that leak no item, with all their columns; see leaks().
    Rows of a null doc_id are judged by their text."""
    ready_to_checkpoint(docs.sparkSession)
    who, th = free_name(docs, "_leak"), free_name(docs, "_th")
    found = _leaks(docs, benchmark, window, share, tokens, broadcast_bytes).select(F.col("doc_id").alias(who), F.col("th").alias(th)).distinct().checkpoint()
    if found.count() * ROW_BYTES <= broadcast_bytes:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(who)) & F.xxhash64("text").eqNullSafe(F.col(th)), "left_anti")

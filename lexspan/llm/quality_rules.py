"""Quality rules on repetition coverage.

For each document, rolling hashes of several n-gram lengths find the n-grams of
words that occur before in the same document, and hashes of whole lines find
repeated lines.  Measured are the characters inside them.  Everything is done
with numpy on Arrow batches; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

U64 = np.uint64
#: n-gram length -> the largest share of characters that duplicated n-grams may cover.
MAX_NGRAM_SHARE = {5: 0.15, 7: 0.13, 10: 0.10}
#: The largest share of characters that repeated lines may hold.
MAX_LINE_SHARE = 0.30

_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False


def _later(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where the same (group, key) stands further left; group never falls."""
    mixed = tx.mix(key + tx.mix(group.astype(U64), 5), 3)
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words in any of the windows of n words that begin at `at`."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(text: pa.ChunkedArray | pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Characters of words, of words in duplicated n-grams, of lines and of repeated lines, by row."""
    rows = len(text)
    out = {k: np.zeros(rows, np.int64) for k in ["n_words", "word_chars", "line_chars", "dup_line_chars", *[f"dup_{n}gram_chars" for n in lengths]]}
    for w in tx.words(text):
        here = slice(w.row0, w.row0 + w.rows)
        before = tx.chars_before(w.data, int(w.bounds[-1]))
        size = before[w.end] - before[w.start]
        row = w.row_of_word()
        add = lambda k, r, x: out[k].__setitem__(here, np.bincount(r, x, w.rows).astype(np.int64))  # noqa: B023, E731
        out["n_words"][here] = np.diff(w.first)
        add("word_chars", row, size)
        for n in lengths:
            at, r = tx.windows(w, n)
            if len(at):
                dup = _later(tx.rolling(w.hash, n)[at], r)
                if dup.any():
                    in_dup = _covered(at[dup], n, len(w))
                    add(f"dup_{n}gram_chars", row[in_dup], size[in_dup])
        start, end = tx.spans(_NOT_NEWLINE[w.data[: int(w.bounds[-1])]], w.bounds)
        if len(start):
            line_row = np.searchsorted(w.bounds, start, side="right") - 1
            line_size = before[end] - before[start]
            dup = _later(tx.word_hash(w.data, start, end), line_row)
            add("line_chars", line_row, line_size)
            add("dup_line_chars", line_row[dup], line_size[dup])
    return out


def _rules(shares: dict[int, float], line_share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lengths = tuple(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _measure(b.column(b.schema.get_field_index("text")), lengths)
            ratio = lambda x, of: np.divide(m[x], m[of], out=np.zeros(b.num_rows), where=m[of] > 0)  # noqa: B023, E731
            cols = {f"dup_{n}gram_share": ratio(f"dup_{n}gram_chars", "word_chars") for n in lengths}
            cols["dup_line_share"] = ratio("dup_line_chars", "line_chars")
            keep = cols["dup_line_share"] <= line_share
            for n, most in shares.items():
                keep &= cols[f"dup_{n}gram_share"] <= most
            keep &= m["n_words"] > 0
            names = ["doc_id", "n_words", *cols, "keep"]
            arrays = [b.column(b.schema.get_field_index("doc_id")), pa.array(m["n_words"]), *[pa.array(c) for c in cols.values()], pa.array(keep)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def repetition(docs: DataFrame, ngram_shares: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """Repetition measures and the decision for each row of docs.

    Result: doc_id, n_words, dup_<n>gram_share for each length, dup_line_share,
    keep.  An n-gram is duplicated if the same n words stand earlier in the
    document; shares are characters of the words that lie in duplicated n-grams
    over characters of all words, and characters of repeated lines over those
    of all lines that aren't empty.  First occurrences don't count.

    keep is false where a share exceeds its limit, however short the document,
    and in documents without any word: null, empty and blank texts have shares
    of 0 and aren't kept.  A null doc_id stays null; repeated
    rows are judged one by one; other columns are ignored whatever their names;
    an empty table gives an empty result; long texts are measured whole.
    """
    shares = MAX_NGRAM_SHARE if ngram_shares is None else ngram_shares
    fields = ["doc_id long", "n_words long", *[f"dup_{n}gram_share double" for n in shares], "dup_line_share double", "keep boolean"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rules(shares, line_share), ", ".join(fields))


def _filter(shares: dict[int, float], line_share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    judge = _rules(shares, line_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blank = pa.nulls(b.num_rows, pa.int64())
            text = b.column(b.schema.get_field_index("text"))
            said = next(judge(iter([pa.RecordBatch.from_arrays([blank, text], names=["doc_id", "text"])])))
            yield b.filter(said.column(said.num_columns - 1))
        tx.release()

    return run


def kept(docs: DataFrame, ngram_shares: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """The rows of docs that repetition() keeps, with all their columns."""
    shares = MAX_NGRAM_SHARE if ngram_shares is None else ngram_shares
    return docs.mapInArrow(_filter(shares, line_share), docs.schema)

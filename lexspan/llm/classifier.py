"""Quality and toxicity by logistic regression over hashed word n-grams.

The model is trained with follow-the-regularised-leader (FTRL-proximal) updates
in one task, on a bounded hash sample of labelled rows, and scored as sparse
dot products: the weights, whose size is fixed by `bits`, go to the workers and
each batch is scored with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._sample import at_most

U64 = np.uint64
BITS = 20
#: The most labelled rows that train the model, on average over hash samples.
SAMPLE = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
TOXIC_LIMIT = 0.3

_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(tx.SPACE)] = 0
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[48:58] = 2


def _pieces(text: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Hashes and rows of the tokens: runs of letters, of digits and of other
    characters, in lower case (ASCII)."""
    data, offs = tx.string_buffers(text)
    for i, j in tx.slices(offs, 1 << 20):
        raw = data[offs[i] : offs[j]]
        part = np.zeros(len(raw) + 16, np.uint8)
        part[: len(raw)] = tx._LOWER[raw]
        bounds = offs[i : j + 1] - offs[i]
        kind = _CLASS[raw]
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[bounds] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        some = kind[start] > 0
        start, end = start[some], end[some]
        h = tx.word_hash(part, start, end)
        yield h, np.searchsorted(bounds, start, side="right") - 1, i, j


def features(text: pa.Array | pa.ChunkedArray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each piece: sorted distinct hashed 1- and 2-grams of each row, where
    each row's begin, and the number of the first row."""
    for h, row, i, j in _pieces(text):
        pair = tx.mix(h[:-1] * U64(3) + h[1:], 11)[row[1:] == row[:-1]] if len(h) > 1 else h[:0]
        pair_row = row[1:][row[1:] == row[:-1]]
        key = np.concatenate([(row.astype(U64) << U64(bits)) | (tx.mix(h, 12) >> U64(64 - bits)), (pair_row.astype(U64) << U64(bits)) | (pair >> U64(64 - bits))])
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        yield (key & U64((1 << bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(j - i + 1, dtype=U64) << U64(bits)), i


class Ftrl:
    """FTRL-proximal logistic regression on binary features; the last weight is the bias."""

    def __init__(self, bits: int) -> None:
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, y: int) -> None:
        i = np.append(i, len(self.z) - 1)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        if abs(g) < 1e-4:
            return
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _train(labels: list[str], bits: int, epochs: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        rows = [x[a:b] for x, first, _ in features(t["text"], bits) for a, b in zip(first[:-1], first[1:])]
        out = []
        for c in labels:
            y = t[c].to_pylist()
            model = Ftrl(bits)
            if {0, 1} <= set(y):
                for _ in range(epochs):
                    for x, v in zip(rows, y):
                        if v in (0, 1) and len(x):
                            model.learn(x, v)
            w = model.weights().astype(np.float32)
            out.append((c, np.flatnonzero(w).astype(np.int64).tobytes(), w[w != 0].tobytes()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], names=["label", "slots", "weights"])

    return run


Weights = dict[str, tuple[bytes, bytes]]


def train(docs: DataFrame, labels: DataFrame, columns: list[str], bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS) -> Weights:
    """Weights that aren't zero, as int64 slots and float32 values, of a model
    for each label column (0, 1 or null) of labels(doc_id, ...).

    At most `sample` labelled rows train it, on average, drawn by a hash of
    doc_id; all of them if there are fewer.  A column without both classes
    gets no weights.  Rows with a null doc_id, a null label or without text
    don't count; of several rows of one doc_id the one of the least text does.
    """
    labelled = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns])
    chosen = at_most(labelled, "doc_id", sample).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    # the sample is bounded, so its side of the join may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in columns]).withColumn("_order", F.xxhash64("doc_id"))
    got = rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_train(columns, bits, epochs), "label string, slots binary, weights binary").collect()
    return {c: (b"", b"") for c in columns} | {r["label"]: (bytes(r["slots"]), bytes(r["weights"])) for r in got}


def _score(weights: list[tuple[bytes, bytes]], bits: int, toxic_limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((len(weights), (1 << bits) + 1), np.float32)
        for k, (slots, values) in enumerate(weights):
            w[k, np.frombuffer(slots, np.int64)] = np.frombuffer(values, np.float32)
        knows = w.any(axis=1)
        for b in batches:
            p = np.zeros((len(w), b.num_rows))
            for x, first, i in features(b.column(1), bits):
                n = len(first) - 1
                row = np.repeat(np.arange(n), np.diff(first))
                for k, v in enumerate(w):
                    p[k, i : i + n] = np.bincount(row, v[x], n) + v[-1]
            p = np.round(1 / (1 + np.exp(-np.clip(p, -35, 35))), 6)
            keep = ((p[0] >= 0.5) | ~knows[0]) & ((p[1] < toxic_limit) | ~knows[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[0]), pa.array(p[1]), pa.array(keep)], names=["doc_id", "quality", "toxic", "keep"])

    return run


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS, toxic_limit: float = TOXIC_LIMIT) -> DataFrame:
    """Probabilities of quality = 1 and toxic = 1 for each row of docs, and the
    decision: (doc_id, quality, toxic, keep).

    labels has doc_id, quality and toxic; of several labels of a doc_id the
    least counts.  keep is true if quality is 0.5 or more and toxic less than
    toxic_limit.  A label without both classes among the labelled rows scores
    0.5 everywhere and rejects nothing.  Texts are read whole, however long.  Null, empty and blank texts are scored
    by the bias alone; null doc_ids stay; repeated rows get equal scores; other
    columns are ignored; an empty table gives an empty result.
    """
    w = train(docs, labels, ["quality", "toxic"], bits, sample, epochs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score([w["quality"], w["toxic"]], bits, toxic_limit), "doc_id long, quality double, toxic double, keep boolean")

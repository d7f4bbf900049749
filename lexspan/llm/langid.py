"""Hierarchical language identification.

A text's language family is predicted first; one-versus-one linear support
vector machines then separate the languages within it.  All machines are
trained by dual coordinate descent in one task on a bounded hash sample of each
language's rows, on square roots of hashed byte n-gram counts scaled to unit
length.  Scoring is one histogram and one small matrix product a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._sample import at_most_each

BITS = 12
#: The most rows of a language that train the machines, on average over hash samples.
SAMPLE = 800
EPOCHS = 12
COST = 10.0
#: Rows whose vectors are held at a time, at most.
ROWS = 512

FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
    "sinitic": ["zh", "yue", "wuu"],
}


def family_of(lang: str, families: dict[str, list[str]]) -> str:
    """The family that lists the language; one of its own if none does."""
    return next((f for f, ls in families.items() if lang in ls), lang)


def vectors(text: pa.Array | pa.ChunkedArray, bits: int = BITS) -> Iterator[tuple[np.ndarray, int]]:
    """Unit vectors of each row's hashed 1-, 2- and 3-grams of bytes; zero for empty rows."""
    data, offs = tx.string_buffers(text)
    size = 1 << bits
    for i, j in tx.slices(offs, 1 << 20, ROWS):
        raw = tx._LOWER[data[offs[i] : offs[j]]].astype(np.uint32)
        bounds = offs[i : j + 1] - offs[i]
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        out = np.zeros((j - i) * size)
        gram = np.zeros(len(raw), np.uint32)
        for n in (1, 2, 3):
            gram = (gram[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :] if len(raw) >= n else raw[:0]
            own = row[: len(gram)]
            same = own == row[n - 1 :] if len(gram) else own.astype(bool)
            slot = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - bits)
            out += np.bincount(own[same] * size + slot[same].astype(np.int64), minlength=len(out))
        x = np.sqrt(out.reshape(j - i, size)).astype(np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        yield np.divide(x, norm, out=x, where=norm > 0), i


def svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear machine with hinge loss; y is -1 or 1."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    a = np.zeros(len(x))
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (float(x[i] @ w[:-1]) + w[-1]) - 1
            new = min(max(a[i] - g / 2, 0), cost)  # a unit vector and the bias make 2
            if new != a[i]:
                step = np.float32((new - a[i]) * y[i])
                w[:-1] += step * x[i]
                w[-1] += step
                a[i] = new
    return w


def _train(families: dict[str, list[str]], bits: int, epochs: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
        x = np.concatenate([v for v, _ in vectors(t["text"], bits)])
        lang = np.array(t["lang"].to_pylist())
        some = x.any(axis=1)
        x, lang = x[some], lang[some]
        family = np.array([family_of(v, families) for v in lang])
        rows = []
        for level, of in [("", family), *[(f, np.where(family == f, lang, "")) for f in sorted(set(family))]]:
            names = sorted(set(of) - {""})
            rows += [(level, n, "", b"") for n in names[:1] if len(names) == 1]
            for a, b in combinations(names, 2):
                pick = (of == a) | (of == b)
                rows.append((level, a, b, svm(x[pick], np.where(of[pick] == a, 1, -1), epochs).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["level", "a", "b", "w"])

    return run


def _vote(duels: list[tuple[str, str, int]], alone: str | None, margin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winners of the one-versus-one duels and their least margin won; most
    wins, then the greater sum of margins, then the alphabet decide."""
    if not duels:
        return np.full(len(rows), alone, object), np.full(len(rows), np.inf)
    names = sorted({n for a, b, _ in duels for n in (a, b)})
    wins, total = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
    for a, b, k in duels:
        m = margin[rows, k]
        for n, v in ((a, m), (b, -m)):
            wins[:, names.index(n)] += v > 0
            total[:, names.index(n)] += v
    best = np.argmax(wins * 1e6 + total, axis=1)
    return np.array(names, object)[best], total[np.arange(len(rows)), best] / (len(names) - 1)


def _predict(machines: list[tuple[str, str, str, bytes]], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duels: dict[str, list[tuple[str, str, int]]] = {}
        alone: dict[str, str] = {}
        weights = []
        for level, a, b, w in machines:
            if b:
                duels.setdefault(level, []).append((a, b, len(weights)))
                weights.append(np.frombuffer(w, np.float32))
            else:
                alone[level] = a
        matrix = np.array(weights, np.float32).T if weights else np.zeros(((1 << bits) + 1, 0), np.float32)
        for batch in batches:
            family = np.full(batch.num_rows, None, object)
            lang = np.full(batch.num_rows, None, object)
            sure = np.full(batch.num_rows, np.nan)
            for x, first in vectors(batch.column(1), bits):
                rows = np.flatnonzero(x.any(axis=1))
                if not len(rows) or not machines:
                    continue
                margin = x @ matrix[:-1] + matrix[-1]
                f, s = _vote(duels.get("", []), alone.get(""), margin, rows)
                family[first + rows] = f
                for name in set(f):
                    here = rows[f == name]
                    lang[first + here], t = _vote(duels.get(name, []), alone.get(name), margin, here)
                    sure[first + here] = np.minimum(s[f == name], t)
            sure[~np.isfinite(sure)] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(np.round(sure, 4).astype(np.float64))], names=["doc_id", "family", "predicted_lang", "margin"])

    return run


def identify(docs: DataFrame, labelled: DataFrame | None = None, families: dict[str, list[str]] | None = None, bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """Predicted family and language of each row of docs: (doc_id, family,
    predicted_lang, margin).

    labelled (by default docs) has doc_id, text and lang; rows of a null lang
    and those without text don't train.  About `sample` rows of each language do, drawn by a hash of
    doc_id, or all if there are fewer; of several rows of one doc_id and lang
    the one of the least text.  A family or language wins by most duels won,
    then by the greater sum of margins, then by the alphabet.  margin is the lesser of the mean
    margins by which the family and the language won, 0 where there was no
    rival.  Null and empty texts, and all texts if nothing is labelled, get null
    predictions and a margin of 0.  Texts are read whole; null doc_ids stay;
    repeated rows get equal results; other columns are ignored; an empty table
    gives an empty result.
    """
    families = FAMILIES if families is None else families
    known = (docs if labelled is None else labelled).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id IS NOT NULL AND trim(text) <> ''")
    chosen = at_most_each(known, "doc_id", "lang", sample).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    machines = chosen.select("doc_id", "text", "lang", F.lit(0).alias("_one")).groupBy("_one").applyInArrow(_train(families, bits, epochs), "level string, a string, b string, w binary").collect()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return out.mapInArrow(_predict([tuple(m) for m in machines], bits), "doc_id long, family string, predicted_lang string, margin double")

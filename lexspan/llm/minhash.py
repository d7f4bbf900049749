"""Near-duplicate groups by circulant MinHash.

Two permutations make all coordinates of a signature: sigma scatters the
shingles, which are hashed into a universe of 2^22 slots, and pi, circularly
shifted by k, gives coordinate k.  As pi's shifts are neighbours in memory, a
shingle's values for all coordinates are one contiguous slice.

1. Texts equal word for word are brought together under a 128-bit hash; one
   row of each goes on.
2. Bands of the signatures put texts into buckets.  No bucket is cut.
3. Each text of a bucket is held against the bucket's least one, its hub, by
   exact Jaccard similarity of their shingle sets.  Near pairs link, and links make groups.
4. Where a bucket holds texts of several groups still, all its pairs between
   these are held against each other too, but for those judged before; the groups
   are then the connected components of all near pairs.

So a bucket of n copies takes n - 1 comparisons, while texts that are only
alike enough to meet in a bucket chain nothing together: what is joined up are near
pairs.  A hub's comparisons are spread over as many tasks as they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._components import components
from ._spark import free_name, ready_to_checkpoint

U64 = np.uint64
SHINGLE = 3
THRESHOLD = 0.6
BANDS = 32
BAND_ROWS = 4
UNIVERSE_BITS = 22
#: Bytes that a row of the tables which may be broadcast takes in memory, about.
ROW_BYTES = 200
#: Texts that are held against a hub in one place, about.
HUB_TEXTS = 256
SEED = 20240607


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi continued circularly by the number of coordinates."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    sigma, pi = (rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32) for _ in range(2))
    return sigma, np.concatenate([pi, pi[:coordinates]])


def shingles(w: tx.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, and where each row's begin.
    A row of fewer words, but one at least, has one shingle of all its words."""
    count = np.diff(w.first)
    roll = tx.rolling(w.hash, n)
    at, row = tx.windows(w, n)
    h = roll[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([tx.mix(np.array([np.bitwise_xor.reduce(tx.mix(w.hash[w.first[r] : w.first[r + 1]] * U64(3) + np.arange(count[r], dtype=U64)))], U64), 9)[0] for r in short], U64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, np.searchsorted(row, np.arange(w.rows + 1))


def signature(h: np.ndarray, permutations: tuple[np.ndarray, np.ndarray], coordinates: int) -> np.ndarray:
    """The coordinates of one set of shingle hashes, which may repeat."""
    sigma, pi = permutations
    s = sigma[(tx.mix(h, 21) >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    rows = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    out = None
    for i in range(0, len(s), 1024):
        part = rows[s[i : i + 1024]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def _signatures(shingle: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        permutations = _permutations(k)
        for b in batches:
            n = b.num_rows
            fp = np.zeros((2, n), U64)
            band = np.zeros((n, bands), np.int64)
            some = np.zeros(n, bool)
            for w in tx.words(b.column(1)):
                h, first = shingles(w, shingle)
                rows_here = np.flatnonzero(np.diff(first))
                if not len(rows_here):
                    continue
                sig = np.array([signature(h[first[r] : first[r + 1]], permutations, k) for r in rows_here.tolist()]).reshape(-1, bands, rows).astype(U64)
                key = np.broadcast_to(np.arange(bands, dtype=U64), (len(rows_here), bands))
                for c in range(rows):
                    key = tx.mix(key ^ sig[:, :, c], 40)
                i = w.row0 + rows_here
                some[i] = True
                band[i] = key.view(np.int64)
                fp[:, i] = _fingerprints(w)[:, rows_here]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(band.ravel()))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), flat], names=["doc_id", "th", "f1", "f2", "bands"])
            yield out.filter(pa.array(some))
        tx.release()

    return run


def _fingerprints(w: tx.Words) -> np.ndarray:
    """128 bits of the words of each row in their order; zeros for rows without words."""
    out = np.zeros((2, w.rows), U64)
    some = np.flatnonzero(np.diff(w.first))
    if len(some):
        order = (np.arange(len(w)) - w.first[w.row_of_word()]).astype(U64)
        out[0, some] = np.add.reduceat(tx.mix(tx.mix(w.hash, 31) ^ (order * U64(0x9E3779B97F4A7C15)), 1), w.first[some])
        out[1, some] = np.add.reduceat(tx.mix(tx.mix(w.hash, 37) + order * U64(0xD1342543DE82EF95), 2), w.first[some])
    return out


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with doc_id, text, f1 and f2, those whose text is the one meant."""
    for b in batches:
        text, f1, f2 = (b.column(b.schema.get_field_index(c)) for c in ("text", "f1", "f2"))
        own = np.zeros(b.num_rows, bool)
        want = np.array([f1.to_numpy(), f2.to_numpy()]).view(U64)
        for w in tx.words(text):
            here = slice(w.row0, w.row0 + w.rows)
            own[here] = (np.diff(w.first) > 0) & (_fingerprints(w) == want[:, here]).all(axis=0)
        yield pa.RecordBatch.from_arrays([f1, text], names=["node", "text"]).filter(pa.array(own))


def _near(shingle: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs at or over the threshold of hubs and the texts that follow each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = 0, np.zeros(0, U64)
        for b in batches:
            a, other, node = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("a", "other", "node"))
            found: list[int] = []
            for w in tx.words(b.column(b.schema.get_field_index("text"))):
                h, first = shingles(w, shingle)
                for r in range(w.rows):
                    i = w.row0 + r
                    own = np.unique(h[first[r] : first[r + 1]])
                    if not other[i]:
                        hub, mine = a[i], own
                        continue
                    if a[i] != hub:
                        raise RuntimeError("a text came before its hub")
                    few, many = sorted((len(own), len(mine)))
                    if few < threshold * many:
                        continue
                    at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                    same = int((mine[at] == own).sum())
                    if same / (few + many - same) >= threshold:
                        found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(node[found])], names=["a", "b"])
        tx.release()

    return run


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of the different pairs (a, b) whose texts are near.  Texts come sorted
    behind their hub's; a hub of many goes to as many places as they need."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_TEXTS).cast("long").alias("groups"))
    hub = groups.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.col("a").alias("node"), F.lit(False).alias("other"))
    rest = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"), F.col("b").alias("node"), F.lit(True).alias("other"))
    rows = hub.unionByName(rest).join(texts, "node").repartition("a", "part").sortWithinPartitions("a", "part", "other")
    return rows.select("a", "other", "node", "text").mapInArrow(_near(shingle, threshold), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Groups of near-duplicate documents.

    Result: doc_id, group_id (the group's least doc_id), keep (true for that
    document), for the members of groups of two or more rows; a document
    without near-duplicates isn't in the result.  Two documents are near if the
    Jaccard similarity of their sets of word shingles is at or over the
    threshold; groups are the connected components.  Case and punctuation
    count.

    Null, empty and blank texts belong to no group.  A text shorter than a
    shingle has one shingle, all its words, so that it is near only to a text
    of the same words.  Rows with a null doc_id can't be named in a group and
    are left out.  Rows are judged one by one: repeated rows (same doc_id and
    text) are members of one group, and a doc_id that stands for several texts
    may be in several groups.  Texts are read whole; other columns are ignored
    whatever their names; an empty table gives an empty result.

    With k rows a band a pair of similarity s is found with probability
    1 - (1 - s^k)^bands: 0.989 at 0.6 and over 0.9997 at 0.7 by default, and in
    groups a document has several chances.
    """
    return _members(docs, shingle, threshold, bands, band_rows, broadcast_bytes).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def _members(docs: DataFrame, shingle: int, threshold: float, bands: int, band_rows: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, a hash of the text, and group_id of each row that is in a group."""
    ready_to_checkpoint(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    signed = docs.withColumn("th", F.xxhash64("text")).mapInArrow(_signatures(shingle, bands, band_rows), "doc_id long, th long, f1 long, f2 long, bands array<long>").checkpoint()
    same = signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    bucket = same.select(F.col("f1").alias("node"), F.explode("bands").alias("band"))
    least = bucket.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("of")).where("of > 1").drop("of")
    bucket = bucket.join(least, "band").checkpoint()
    stars = bucket.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().checkpoint()
    chosen = same.select("f1", "f2", "doc_id").join(bucket.select(F.col("node").alias("f1")).distinct(), "f1").checkpoint()
    if chosen.count() * ROW_BYTES <= broadcast_bytes:
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, "doc_id").mapInArrow(_own_texts, "node long, text string").dropDuplicates(["node"]).checkpoint()
    links = _linked(stars, texts, shingle, threshold).checkpoint()
    label = components(links)
    # buckets that hold several groups
    placed = bucket.select("band", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("of")).where("x <> y AND of > 2").select("band")
    placed = placed.join(mixed, "band").checkpoint()
    here = placed.select("band", "component").distinct()
    meet = here.withColumnRenamed("component", "one").join(here.withColumnRenamed("component", "two"), "band").where("one < two")
    for side, name in (("one", "x"), ("two", "y")):
        meet = meet.join(placed.select("band", F.col("node").alias(name), F.col("component").alias(side)), ["band", side])
    more = meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti").checkpoint()
    links = links.unionByName(_linked(more, texts, shingle, threshold)).checkpoint()
    member = components(links)
    linked = same.select("f1", "f2", "doc_id", "n").join(member.withColumnRenamed("node", "f1"), "f1")
    group = linked.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    exact = linked.join(group, "component").select("f1", "f2", "group_id")
    alone = same.where("n > 1").select("f1", "f2", F.col("doc_id").alias("own_id"))
    group = exact.join(alone, ["f1", "f2"], "full").select("f1", "f2", F.coalesce("group_id", "own_id").alias("group_id"))
    return signed.select("doc_id", "th", "f1", "f2").join(group, ["f1", "f2"]).select("doc_id", "th", "group_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs with one row of each group of near_groups(), and all rows in no group.

    The row that stays is one of the group's least doc_id.  Rows of a null
    doc_id are grouped like others, by a number of 2^62 or more that their text
    gives, so that one stays only where no lesser doc_id is in the group.  Rows
    whose text is null or blank are in no group and stay.  All columns are
    returned, and may have any names.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))))
    member = _members(docs.select(number.alias("doc_id"), "text"), shingle, threshold, bands, band_rows, broadcast_bytes).checkpoint()
    best = member.where("doc_id = group_id").groupBy("group_id").agg(F.min("th").alias("best"))
    who, th = free_name(docs, "_member"), free_name(docs, "_th")
    judged = member.join(best, "group_id").groupBy(F.col("doc_id").alias(who), F.col("th").alias(th))
    judged = judged.agg(F.max((F.col("doc_id") == F.col("group_id")) & (F.col("th") == F.col("best"))).alias("stays"), F.count("*").alias("rows")).checkpoint()
    again = F.expr("stays AND rows > 1")
    n = judged.agg(F.count("*").alias("n"), F.count_if(again).alias("more")).first()
    small = F.broadcast if n["n"] * ROW_BYTES <= broadcast_bytes else (lambda x: x)
    here = (number == F.col(who)) & (F.xxhash64("text") == F.col(th))
    kept = docs.join(small(judged.where("NOT stays OR rows > 1").select(who, th)), here, "left_anti")
    if n["more"]:  # repeated rows of the document that stays
        repeated = docs.join(small(judged.where(again).select(who, th)), here)
        kept = kept.unionByName(repeated.dropDuplicates([who, th]).select(docs.columns))
    return kept

import random

import numpy as np
import pytest

from lexspan.llm import minhash, substring, suffix_array
from lexspan.llm import _text as tx
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = "_chunk string, _member int, _th int, _leak int, th int, keep string, group_id string, f1 int, bands int, component int, n int, rep int, kind int, body string, piece int, part int, score int, family int"


def rows_of(seed=1, n=40):
    """Prose of a few words with passages, copies, edits, nulls, empties, a repeated row and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = [prose(12), prose(30), "é " * 11 + "ß"]
    rows = []
    for i in range(n):
        t = prose(rng.randint(1, 60))
        if i % 3 == 0:
            t += rng.choice([" ", "\n", "\t"]) + rng.choice(passage) + "\n" + prose(5)
        rows.append((i * 7 % n, t))
    base = prose(80).split()
    for i in range(6):
        e = list(base)
        e[rng.randrange(80)] = f"edit{i}"
        rows.append((100 + i, " ".join(e)))
    rows += [(200, " ".join(base)), (201, " ".join(base)), (201, " ".join(base)), (202, "two words"), (203, "two words"), (204, "two  words\n")]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, passage[0] + " tail"), (None, None), (303, "x " * 3000), (304, "y" * 5000), (201, passage[1])]
    return rows


def frame(spark, rows, clash=False):
    full = [(d, t, "en", None, None if t is None else len(t)) for d, t in rows]
    if not clash:
        return spark.createDataFrame(full, SCHEMA)
    extra = CLASH.split(", ")
    return spark.createDataFrame([r + tuple("7" if c.endswith("string") else 7 for c in extra) for r in full], f"{SCHEMA}, {CLASH}")


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("chunk_bytes", [1 << 22, 3000])
def test_spans_equal_brute_force(spark, clash, chunk_bytes):
    rows = rows_of()
    df = frame(spark, rows, clash)
    want = sorted(brute.repeated_spans(rows, 10), key=repr)
    for op in (lambda: substring.repeated_spans(df, 10, chunk_bytes=chunk_bytes), lambda: suffix_array.repeated_spans(df, 10, 4, chunk_bytes=chunk_bytes)):
        assert sorted(map(tuple, op().collect()), key=repr) == want
    assert len(want) > 10


def test_a_sketch_row_alone_loses_nothing(spark):
    rows = rows_of(2)
    got = substring.repeated_spans(frame(spark, rows), 10, depth=1, chunk_bytes=2000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.repeated_spans(rows, 10), key=repr)


def test_cut_texts_equal_brute_force(spark):
    rows = rows_of(3)
    df = frame(spark, rows, True)
    out = substring.without_repeats(df, 10, chunk_bytes=3000)
    assert out.columns == df.columns and out.schema == df.schema
    got = out.collect()
    key = lambda x: (repr(x[0]), x[1])
    assert sorted(((r.doc_id, brute.words(r.text)) for r in got), key=key) == sorted(brute.without_repeats(rows, 10), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert {(r.doc_id, r.text) for r in got if r.text is None} == {(300, None), (None, None)}


def test_cut_keeps_the_white_space_that_stays(spark):
    p = "a b c d e f g h i j"
    rows = [(1, p), (2, f"head\n\n{p}\n\ttail  "), (3, f"{p} end"), (4, f"start  {p} \n")]
    got = {r.doc_id: r.text for r in substring.without_repeats(frame(spark, rows), 10).collect()}
    assert got == {1: p, 2: "head\n\ntail  ", 3: "end", 4: "start"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for df in (substring.repeated_spans(empty), suffix_array.repeated_spans(empty), minhash.near_groups(empty), substring.without_repeats(empty), minhash.one_of_each(empty)):
        assert df.collect() == []
    blank = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0)], SCHEMA)
    assert substring.repeated_spans(blank).count() == suffix_array.repeated_spans(blank).count() == minhash.near_groups(blank).count() == 0
    assert minhash.one_of_each(blank).count() == substring.without_repeats(blank).count() == 2


@pytest.mark.parametrize("clash", [False, True])
def test_rows_without_doc_id_are_grouped_too(spark, clash):
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(90)) for _ in range(4))
    near = lambda t: t.rsplit(" ", 2)[0] + " some other end"
    rows = [(5, a), (None, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (None, c), (9, c), (None, d), (None, None), (None, None), (None, "")]
    for limit in (32 << 20, 0):
        got = [(r.doc_id, r.text) for r in minhash.one_of_each(frame(spark, rows, clash), broadcast_bytes=limit).collect()]
        of_b = [r for r in got if r[1] in (b, near(b))]
        assert len(of_b) == 1 and of_b[0][0] is None
        assert sorted((r for r in got if r not in of_b), key=repr) == sorted([(5, a), (9, c), (None, d), (None, None), (None, None), (None, "")], key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_near_groups_equal_brute_force(spark, clash):
    rows = rows_of(4)
    df = frame(spark, rows, clash)
    group = brute.near_groups(rows)
    want = sorted((rows[i][0], g, rows[i][0] == g) for i, g in group.items())
    assert sorted(map(tuple, minhash.near_groups(df).collect())) == want
    assert len(want) > 8
    assert sorted(map(tuple, minhash.near_groups(df, broadcast_bytes=0).collect())) == want


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_one_of_each_group_stays(spark, limit):
    rows = rows_of(5)
    df = frame(spark, rows, True)
    out = minhash.one_of_each(df, broadcast_bytes=limit)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    group = brute.near_groups(rows)
    best = {}
    for i, g in group.items():
        if rows[i][0] == g:
            best.setdefault(g, set()).add(rows[i][1])
    alone = [r for i, r in enumerate(rows) if i not in group]
    assert len(got) == len(alone) + len(best)
    assert all(r in got for r in alone)
    for g, texts in best.items():
        assert len([r for r in got if r not in alone and r[0] == g]) == 1
        assert any((g, t) in got for t in texts)


def test_a_chain_is_one_group(spark):
    w = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(w[: 60 - 9 * k] + [f"c{k}x{i}" for i in range(9 * k)])) for k in range(4)]
    rows += [(9, " ".join(w[:60])), (8, " ".join(w[:60]))]
    got = {(r.doc_id, r.group_id) for r in minhash.near_groups(frame(spark, rows)).collect()}
    assert got == {(rows[i][0], g) for i, g in brute.near_groups(rows).items()}


def test_a_long_chain_and_a_crowd_of_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_TEXTS", 8)
    w = [f"t{i}" for i in range(1200)]
    chain = [(k, " ".join(w[5 * k : 5 * k + 60])) for k in range(200)]  # only neighbours are near
    base = [f"b{i}" for i in range(90)]
    crowd = [(1000 + k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]])) for k in range(90)]
    # alike enough to meet in buckets, but not near
    loose = [(2000 + k, " ".join([*base[: 45 + k % 3], *(f"l{k}x{i}" for i in range(45))])) for k in range(30)]
    rows = chain + crowd + loose
    got = {(r.doc_id, r.group_id) for r in minhash.near_groups(frame(spark, rows)).collect()}
    assert got == {(rows[i][0], g) for i, g in brute.near_groups(rows).items()}
    assert {g for d, g in got} >= {0, 1000} and len(got) >= 290


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pi = minhash._permutations(128)
    for j in (0.3, 0.6, 0.9):
        est = []
        for _ in range(40):
            common = rng.integers(0, 1 << 63, int(1000 * j)).astype(np.uint64)
            own = [rng.integers(0, 1 << 63, int(1000 * (1 - j) / 2)).astype(np.uint64) for _ in range(2)]
            a, b = (minhash.signature(np.concatenate([common, x]), pi, 128) for x in own)
            est.append((a == b).mean())
        assert abs(np.mean(est) - j) < 0.03


def test_recall_of_candidates():
    rng = np.random.default_rng(5)
    pi = minhash._permutations(128)
    found = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        own = [rng.integers(0, 1 << 63, 90).astype(np.uint64) for _ in range(2)]  # similarity 0.625
        a, b = (minhash.signature(np.concatenate([common, x]), pi, 128).reshape(32, 4) for x in own)
        found += (a == b).all(axis=1).any()
    assert found >= 190


def test_suffix_array_and_common_prefixes_equal_a_plain_sort():
    rng = np.random.default_rng(1)
    for _ in range(150):
        pieces = [rng.integers(1, rng.integers(2, 6) + 1, rng.integers(1, 40)).tolist() for _ in range(rng.integers(1, 6))]
        s = np.array([x for p in pieces for x in [*p, 0]])
        stop = [next(j for j in range(i, len(s)) if s[j] == 0) for i in range(len(s))]
        want = sorted(range(len(s)), key=lambda i: (s[i : stop[i]].tolist(), stop[i]))
        sa = suffix_array.suffix_array(s)
        assert sa.tolist() == want
        prefix = lambda a, b: next(k for k in range(len(s)) if s[a + k] != s[b + k] or s[a + k] == 0)
        assert suffix_array.common_prefixes(s, sa).tolist() == [0, *(prefix(a, b) for a, b in zip(want, want[1:]))]
    assert suffix_array.suffix_array(np.zeros(0, np.int64)).tolist() == []


def test_one_layout_at_all_sizes():
    from lexspan.llm._spark import layout

    last = 0.0
    for power in range(3, 15):
        chunks, shards = layout(10**power)
        assert 1 <= shards <= chunks < 1 << 31
        assert chunks >= last
        last = chunks
    per_byte = [c * s / z for z in (10**9, 10**12) for c, s in [layout(z)]]
    assert 9 < per_byte[1] / per_byte[0] < 11  # pieces a byte grow with the cube root


@pytest.mark.parametrize("piece", [1, 64])
def test_sketch_shards_are_added_up_in_stretches(spark, monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(substring, "PIECE", piece)
    rng = np.random.default_rng(7)
    cells = [np.unique(rng.integers(0, 1 << 16, 900)).astype(np.uint64) for _ in range(3)]
    low, high = substring._bounds(16, 3)[1:3].tolist()
    mine = [c[(c >= low) & (c < high)] for c in cells]
    rows = [(k, 0, 1, tx.put_sorted(c), np.ones(len(c), np.uint8).tobytes()) for k, c in enumerate(mine)]
    t = substring._table(rows, ("_chunk", "kind", "shard", "body", "counts"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))
    got = substring._merge_sketch(16, 3)((pa.scalar(0), pa.scalar(1)), t)
    times = {}
    for c in mine:
        for x in c.tolist():
            times[x] = times.get(x, 0) + 1
    assert {k: tx.get_sorted(b).tolist() for k, b in zip(got["_chunk"].to_pylist(), got["body"].to_pylist())} == {k: [x for x in c.tolist() if times[x] > 1] for k, c in enumerate(mine)}


def test_words_of_any_bytes():
    import pyarrow as pa

    texts = ["a b", None, "", "  lead", "é\tß\r\n語", "x" * 1000 + " " + "y" * 9, "no-space", "\x0bv\x0cf"]
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])] for w in tx.words(pa.array(texts), 8) for r in range(w.rows)]
    assert got == [brute.words(t) for t in texts]

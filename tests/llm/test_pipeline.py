"""The pipeline against a brute-force version of its stages."""

import random

import corpus_pipeline
from lexspan.llm import packing, quality_rules, substring
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = prose(25)
    passage = prose(70)
    rows = [(i, " ".join(prose(rng.randint(20, 300)))) for i in range(60)]
    for i in range(60, 70):  # share a passage of over 50 words
        rows.append((i, " ".join(prose(40) + passage + prose(60))))
    base = prose(200)
    for i in range(70, 76):  # near and exact copies
        e = list(base)
        if i > 72:
            e[i] = "edited"
        rows.append((i, " ".join(e)))
    rows += [(80, " ".join(prose(30) + item + prose(30))), (81, " ".join(item)), (90, "spam eggs " * 60), (91, None), (92, ""), (93, " ".join(prose(5000)))]
    return rows, [(1, " ".join(item)), (2, " ".join(prose(20)))]


def expected(rows, items):
    def good(t):
        n = len(brute.words(t))
        shares, lines = brute.repetition(t, quality_rules.MAX_NGRAM_SHARE)
        return n > 0 and lines <= quality_rules.MAX_LINE_SHARE and all(shares[k] <= v for k, v in quality_rules.MAX_NGRAM_SHARE.items())

    rows = [r for r in rows if good(r[1])]
    group = brute.near_groups(rows)
    rows = [r for i, r in enumerate(rows) if group.get(i, r[0]) == r[0]]
    rows = brute.without_repeats(rows, substring.WINDOW)
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    leak = set().union(*(grams(brute.words(t)) for _, t in items))
    return [(d, w) for d, w in rows if not grams(w) & leak]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected(rows, items)
    assert not {73, 74, 75, 80, 81, 90, 91, 92} & {d for d, _ in want} and len(want) > 60
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {}
    for r in sorted(got, key=lambda r: r.piece):
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
    assert {d: brute.words(t) for d, t in text.items()} == {d: w for d, w in want if w}
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {d: len(w) for d, w in want if w}
    pieces = [n for d, w in want for n in [packing.CAPACITY] * (len(w) // packing.CAPACITY) + [len(w) % packing.CAPACITY] if n]
    assert len({r.bin_id for r in got}) == brute.best_fit_decreasing(pieces, packing.CAPACITY)


def test_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, "a b c", "en", "s", None, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "w " * 3, "en", "s", 6, 4), (3, "w " * 3, "en", "s", 6, 4), (3, "other", "en", "s", 5, 4)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, f"{SCHEMA}, _chunk int")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.collect()


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
    assert corpus_pipeline.ORACLE_SQL is None and set(__spark_entry__.oracle_sql()) <= names

"""Documents of several megabytes, beyond any slice or chunk, and many empty ones."""

import random

import pytest

from lexspan.llm import classifier, decontaminate, langid, minhash, ngram_lm, packing, quality_rules, substring, suffix_array
from tests.llm import brute
from tests.llm.test_dedup import frame


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = prose(60)
    long = prose(400_000) + passage + prose(400_000)
    assert len(" ".join(long)) > 4 << 20
    edited = list(long)
    edited[200_000] = "edited"
    return long, [(1, " ".join(long)), (2, " ".join(prose(30) + passage + prose(30))), (3, " ".join(edited)), (4, ""), (5, None)], passage


def test_long_texts_repeat(spark, rows):
    long, docs, _ = rows
    n = len(long)
    df = frame(spark, docs)
    want = [(1, 0, 200_000, False), (1, 200_001, n, False), (2, 30, 90, True), (3, 0, 200_000, True), (3, 200_001, n, True)]
    for op in (substring, suffix_array):
        assert sorted(map(tuple, op.repeated_spans(df).collect())) == want
    left = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert left[1] == docs[0][1] and left[3] == "edited" and len(left[2].split()) == 60


def test_long_texts_are_near(spark, rows):
    assert sorted(map(tuple, minhash.near_groups(frame(spark, rows[1])).collect())) == [(1, 1, True), (3, 1, False)]
    assert {r.doc_id for r in minhash.one_of_each(frame(spark, rows[1])).collect()} == {1, 2, 4, 5}


def test_long_texts_are_measured_whole(spark, rows):
    long, docs, passage = rows
    df = frame(spark, docs)
    n = {d: len(brute.words(t)) for d, t in docs}
    rules = {r.doc_id: r for r in quality_rules.repetition(df).collect()}
    assert {d: r.n_words for d, r in rules.items()} == n and rules[1].keep and not rules[4].keep
    size = {}
    for r in packing.pack(df).collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {d: k for d, k in n.items() if k}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert classifier.score(df, labels).count() == langid.identify(df).count() == len(docs)
    scores = {r.doc_id: r for r in ngram_lm.perplexity(df).collect()}
    assert {d: r.n_words for d, r in scores.items()} == n and scores[1].perplexity > 1 and scores[5].perplexity is None
    b = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    assert {(r.doc_id, r.covered) for r in decontaminate.leaks(df, b).collect()} == {(1, 60), (2, 60), (3, 60)}


def test_many_empty_texts(spark):
    df = frame(spark, [(1, "a b c")]).unionByName(spark.range(100, 100_100).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "NULL AS source", "0L AS n_chars"))
    assert langid.identify(df).where("predicted_lang IS NULL").count() == 100_000
    assert minhash.near_groups(df).count() == substring.repeated_spans(df).count() == 0
    assert quality_rules.kept(df).count() == packing.pack(df).count() == 1
    assert ngram_lm.perplexity(df).where("perplexity IS NOT NULL").count() == 1

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexspan.llm import _text as tx
from lexspan.llm import classifier, decontaminate, langid, ngram_lm, packing, quality_rules, reply_trees
from tests.llm import brute
from tests.llm.test_dedup import SCHEMA, frame, rows_of

SYLLABLES = {"en": "the ing er tion and", "de": "ung ich schen der und", "fr": "eau ment que les une", "es": "cion ado que los mente"}


def corpus(seed, n=40):
    """Documents in four languages; quality 0 has symbols, toxic has a marked word."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n * 4):
        lang = list(SYLLABLES)[i % 4]
        syl = SYLLABLES[lang].split()
        w = ["".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        good, toxic = int(rng.random() < 0.6), int(rng.random() < 0.4)
        if not good:
            w = [x + "###" for x in w]
        if toxic:
            w[rng.randrange(40)] = "nasty"
        docs.append((i, " ".join(w), lang, None, None))
        labels.append((i, good, toxic))
    return docs, labels


def test_repetition_equals_brute_force(spark):
    rows = rows_of(6) + [(400, "a b c d e f\n" * 9), (401, "same line\nsame line\n\nother"), (402, "z " * 50), (403, "short short"), (405, "spam " * 6), (406, "a\na\nb"), (404, "ü ö ü ö ü ö ü ö ü ö ü ö ü ö")]
    got = quality_rules.repetition(frame(spark, rows, True)).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        shares, lines = brute.repetition(t, quality_rules.MAX_NGRAM_SHARE)
        n = len(brute.words(t))
        fine = lines <= quality_rules.MAX_LINE_SHARE and all(shares[k] <= m for k, m in quality_rules.MAX_NGRAM_SHARE.items())
        want.append((d, n, *shares.values(), lines, n > 0 and fine))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r.keep for r in got}) == 2
    kept = quality_rules.kept(frame(spark, rows, True))
    assert kept.columns == frame(spark, rows, True).columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted((repr(w[0]), t) for w, (_, t) in zip(want, rows) if w[-1])
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.repetition(empty).count() == quality_rules.kept(empty).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA)
    train = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.score(df, train).collect()}
    held = [x for x in labels if x[0] % 4 == 0]
    assert np.mean([(got[d].quality >= 0.5) == bool(q) for d, q, _ in held]) > 0.9
    assert np.mean([(got[d].toxic >= classifier.TOXIC_LIMIT) == bool(t) for d, _, t in held]) > 0.9


def test_scores_are_sparse_dot_products(spark):
    docs, labels = corpus(2)
    df = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    slots, values = classifier.train(df, lab, ["quality"])["quality"]
    w = dict(zip(np.frombuffer(slots, np.int64).tolist(), np.frombuffer(values, np.float32).tolist()))
    import pyarrow as pa

    got = {r.doc_id: r.quality for r in classifier.score(df, lab).collect()}
    for d, t, *_ in docs[:20]:
        x, first, _ = next(classifier.features(pa.array([t])))
        assert len(set(x.tolist())) == len(x) == first[1]
        z = sum(w.get(i, 0.0) for i in x.tolist()) + w.get(1 << classifier.BITS, 0.0)
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 1e-5


def plain_slots(text, bits):
    """Hashed 1- and 2-grams of a text, token by token."""
    import re

    tokens = [m[0].lower().encode() for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z\x80-\U0010ffff0-9 \t\n\r\x0b\x0c]+", text or "")]
    h = [int(tx.word_hash(np.frombuffer(t + bytes(16), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    mixed = lambda x, salt: int(tx.mix(np.array([x % (1 << 64)], np.uint64), salt)[0]) >> (64 - bits)
    return {mixed(x, 12) for x in h} | {mixed(x * 3 + y, 11) for x, y in zip(h, h[1:])}


def test_training_equals_plain_ftrl(spark):
    docs, labels = corpus(5, 20)
    docs += [(1, "of two texts the least trains", "en", None, None), (500, None, "en", None, None)]
    labels += [(2, 0, None), (500, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classifier.train(df, lab, ["quality", "toxic"], bits=14, epochs=2)
    text = {}
    for d, t, *_ in docs:
        if t is not None:
            text[d] = min(text.get(d, t), t)
    order = {r.doc_id: r.o for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}
    for k, name in enumerate(("quality", "toxic"), 1):
        y = {}
        for row in labels:
            if row[0] is not None and row[k] is not None:
                y[row[0]] = min(y.get(row[0], 1), row[k])
        z, n, bias = {}, {}, 1 << 14

        def weight(i):
            if abs(z.get(i, 0.0)) <= classifier.L1:  # noqa: B023
                return 0.0
            return (math.copysign(classifier.L1, z[i]) - z[i]) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)  # noqa: B023

        for _ in range(2):
            for d in sorted((d for d in y if d in text), key=order.get):
                x = plain_slots(text[d], 14)
                if not x:
                    continue
                w = {i: weight(i) for i in (*x, bias)}
                g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y[d]
                if abs(g) < 1e-4:
                    continue
                for i, v in w.items():
                    was = n.get(i, 0.0)
                    z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / classifier.ALPHA * v
                    n[i] = was + g * g
        slots, values = got[name]
        mine = dict(zip(np.frombuffer(slots, np.int64).tolist(), np.frombuffer(values, np.float32).tolist()))
        want = {i: weight(i) for i in z if weight(i)}
        assert mine.keys() == want.keys() and len(want) > 1
        assert all(abs(mine[i] - want[i]) < 1e-4 for i in want)


def test_classifier_edges(spark):
    rows = rows_of(7)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classifier.score(frame(spark, rows, True), none).collect()
    assert len(got) == len(rows) and all(r.quality == r.toxic == 0.5 and r.keep for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (100, None, 1), (100, 0, None), (101, 1, 0), (102, 0, 0), (300, 1, 1), (301, 0, 1)], "doc_id long, quality int, toxic int")
    assert classifier.score(frame(spark, rows), odd).count() == len(rows)
    assert classifier.score(spark.createDataFrame([], SCHEMA), odd).count() == 0


def test_language_on_held_out_rows(spark):
    docs, _ = corpus(3)
    known = spark.createDataFrame([d for d in docs if d[0] % 3], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, SCHEMA), known, sample=60).collect()}
    held = [d for d in docs if d[0] % 3 == 0]
    assert np.mean([got[d[0]].predicted_lang == d[2] for d in held]) > 0.95
    assert all(got[d[0]].family == langid.family_of(got[d[0]].predicted_lang, langid.FAMILIES) for d in held)


def test_language_edges(spark):
    rows = rows_of(8)
    df = frame(spark, rows, True)
    got = langid.identify(df).collect()  # one language only
    assert len(got) == len(rows)
    assert all((r.predicted_lang, r.family) == ("en", "germanic") for r, (_, t) in zip(sorted(got, key=repr), sorted(rows, key=repr)) if r.predicted_lang)
    none = langid.identify(df.withColumn("lang", df.lang.substr(1, 0)).where("false"), df.where("false"))
    assert none.collect() == []
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert all(r.predicted_lang is None and r.margin == 0 for r in langid.identify(unlabelled).collect())
    assert langid.family_of("xx", langid.FAMILIES) == "xx"


def test_languages_equal_plain_duels(spark):
    docs, _ = corpus(6, 15)
    docs += [(900, None, "en", None, None), (901, "", "de", None, None), (902, "x" * 3000, None, None, None), (None, docs[0][1], None, None, None), (903, "ß é", "it", None, None), (904, "uno due tre", "it", None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r.doc_id, r.text): r for r in langid.identify(df, sample=9999).join(df.select("doc_id", "text").distinct(), "doc_id").collect()}
    import pyarrow as pa

    def vector(text):
        raw = (text or "").encode().lower()
        out = np.zeros(1 << langid.BITS)
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                gram = int.from_bytes(raw[i : i + n], "big")
                out[(((gram * 2654435761 + n * 40503) * 2246822519) % (1 << 32)) >> (32 - langid.BITS)] += 1
        out = np.sqrt(out)
        return (out / np.linalg.norm(out) if out.any() else out).astype(np.float32)

    for t in ("", "a", "Ab c", docs[0][1]):
        assert np.allclose(next(langid.vectors(pa.array([t])))[0][0], vector(t))
    known = pa.table({k: pa.array([d[i] for d in docs if d[0] is not None and d[1] is not None and d[2]], t) for k, i, t in (("doc_id", 0, pa.int64()), ("text", 1, pa.string()), ("lang", 2, pa.string()))})
    machines = {}
    for level, a, b, w in zip(*(c.to_pylist() for c in langid._train(langid.FAMILIES, langid.BITS, langid.EPOCHS)(known).columns)):
        machines.setdefault(level, []).append((a, b, np.frombuffer(w, np.float32)))

    def winner(level, x):
        if not machines[level][0][1]:
            return machines[level][0][0]
        wins, total = {}, {}
        for a, b, w in machines[level]:
            m = float(x @ w[:-1] + w[-1])
            for n, v in ((a, m), (b, -m)):
                wins[n] = wins.get(n, 0) + (v > 0)
                total[n] = total.get(n, 0) + v
        return min(wins, key=lambda n: (-wins[n], -total[n], n))

    assert len(machines) == 3 and len(machines["romance"]) == 3
    for (d, t), r in got.items():
        x = vector(t)
        family = winner("", x) if x.any() else None
        assert (r.family, r.predicted_lang) == (family, winner(family, x) if family else None), (d, t)
    assert len(got) == len(docs) - 1


def test_many_empty_texts_take_little_memory():
    import resource

    import pyarrow as pa

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = sum(len(x) for x, _ in langid.vectors(pa.array([""] * 100_000)))
    assert rows == 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_languages_that_tie_go_by_the_alphabet():
    duels = [("a", "b", 0), ("a", "c", 1), ("b", "c", 2)]
    margin = np.array([[1.0, -1.0, 1.0], [0.0, 0.0, 0.0]])  # a beats b, c beats a, b beats c; no one beats anyone
    assert langid._vote(duels, None, margin, np.array([0, 1]))[0].tolist() == ["a", "a"]


def test_svm_is_near_the_least_objective():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=120) > 0, 1, -1)
    x1 = np.c_[x, np.ones(120)]
    objective = lambda w: 0.5 * w @ w + langid.COST * np.maximum(0, 1 - y * (x1 @ w)).sum()
    mine = objective(langid.svm(x, y, 300).astype(float))
    w, best = np.zeros(9), np.inf
    for t in range(1, 20_001):  # plain subgradient descent
        g = w - langid.COST * ((y * (x1 @ w) < 1) * y) @ x1
        w = w - g / t
        best = min(best, objective(w))
    assert mine <= best * 1.01


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 20)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ np.arange(20) > 0, 1, -1)
    w = langid.svm(x, y, 40)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.95


@pytest.mark.parametrize(("order", "shards"), [(1, 1), (1, 4), (2, 3), (3, 1), (3, 7)])
def test_kneser_ney_equals_its_definition(spark, order, shards):
    rows = [(i, t) for i, (_, t) in enumerate(rows_of(9))]
    docs = frame(spark, rows, True)
    got = {r.doc_id: r for r in ngram_lm.perplexity(docs, ngram_lm.train(docs, order, shards)).collect()}
    for (d, t), want in zip(rows, brute.kneser_ney([t for _, t in rows], order)):
        if want is None:
            assert got[d].log_prob is None and got[d].perplexity is None and got[d].n_words == 0
        else:
            n = len(brute.words(t))
            assert got[d].n_words == n and abs(got[d].log_prob - want) < 1e-3
            assert abs(got[d].perplexity / math.exp(-want / (n + 1)) - 1) < 1e-4


def test_the_registered_query_scores_trigrams(spark, tmp_path):
    from lexspan.llm import queries

    rows = [(i, t) for i, (_, t) in enumerate(rows_of(9))]
    frame(spark, rows, True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_prob for r in queries.op10_lm_scoring(spark, str(tmp_path)).collect()}
    for (d, _), want in zip(rows, brute.kneser_ney([t for _, t in rows], 3)):
        assert got[d] is None if want is None else abs(got[d] - want) < 1e-3


def test_kneser_ney_is_a_distribution_and_takes_unseen_words(spark):
    rows = [(1, "a b a b c"), (2, "a b d"), (3, None)]
    model = ngram_lm.train(frame(spark, rows), 2)
    import pyarrow as pa

    vocab = next(ngram_lm.sequences(pa.array(["a b c d unseen"]), 2))[0][1:]
    scorer = ngram_lm.Scorer(model)
    for context in vocab[[0, 1, 4]]:
        assert abs(scorer.probability([np.full(6, context), vocab]).sum() - 1) < 1e-9
    other = ngram_lm.perplexity(frame(spark, [(9, "unseen words"), (None, "a b"), (8, "")]), model).collect()
    assert sorted(repr(r.doc_id) for r in other if r.perplexity) == ["9", "None"]
    assert ngram_lm.perplexity(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(0, 1 << 48, 300).astype(np.uint64)) << np.uint64(16)
    for n in (1, 2, 3):
        columns = [np.minimum(rng.geometric(0.02, 400), 299) for _ in range(n)]
        columns, values = ngram_lm._summed(columns, [rng.integers(0, 1 << 40, 400), np.ones(400, np.int64)], len(words))
        got, known, sums = ngram_lm._unpack(ngram_lm._pack(columns, words, values), n)
        rows = lambda c, w, v: sorted(zip(*(w[x].tolist() for x in c), *(x.tolist() for x in v)))
        assert rows(got, known, sums) == rows(columns, words, values)
    assert [len(x) for x in ngram_lm._unpack(ngram_lm._pack([np.zeros(0, np.int64)], words, []), 1)[0]] == [0]


def test_rows_of_many_words_keep_their_order():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 1 << 30, 500) for _ in range(3)]
    rows = list(zip(*(c.tolist() for c in columns)))
    assert np.argsort(ngram_lm._rank(columns, 31)).tolist() == sorted(range(500), key=rows.__getitem__)


@pytest.mark.parametrize("shards", [1, 5])
def test_stored_hashes_are_found(shards):
    rng = np.random.default_rng(3)
    for shard in range(shards):
        low, span = ngram_lm._range(shard, shards)
        keys = np.unique(np.array([low + int(x * (span - 1)) for x in rng.random(5000)] + [low, low + 1, low + 2, low + span - 1], np.uint64))
        assert (ngram_lm._shard(keys, shards) == shard).all()
        table = ngram_lm._Keys(ngram_lm._keyed(keys, low, span))
        assert len(table.twins) >= 3  # hashes that three bytes don't tell apart
        assert (table.find(keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(np.array([low + int(x * (span - 1)) for x in rng.random(5000)], np.uint64), keys)
        assert (table.find(other) >= 0).mean() < 0.001
    assert ngram_lm._Keys(ngram_lm._keyed(keys[:0], 0, 1 << 64)).find(keys[:3]).tolist() == [-1] * 3


def test_coded_counts_come_back():
    rng = np.random.default_rng(5)
    for n, size in ((1, 3000), (1, 2999), (4, 3000), (1, 0)):
        values = [np.where(rng.random(size) < 0.9, rng.integers(0, 3, size), rng.integers(0, 1 << 40, size)) for _ in range(n)]
        got = ngram_lm._Values(ngram_lm._coded(values)).at(np.arange(size))
        assert all((g == v).all() for g, v in zip(got, values))


ITEM = "Alice has 12 apples and 7 pears and gives 3 kg of the fruit to Bob who then sells 5 of the apples to Alice for 2 dollars"
OTHER = "So Zoe has 31 apples and 9 pears and gives 4 miles of the fruit to Yan who then sells 8 of the apples to Zoe for 6 euros"
WRONG = "So Zoe has 31 apples and 9 pears and gives 4 miles of the fruit to Yan who then sells 8 of the apples to Max for 6 euros"


def test_leaks(spark):
    filler = "some plain words stand here before and after all of the rest "
    rows = [(1, filler + "Here " + ITEM + " . " + filler), (2, filler + OTHER), (3, filler * 5), (4, None), (5, ""), (None, OTHER), (6, filler + "exactly seven words make this item up " + filler), (7, OTHER), (7, OTHER), (8, "A B C D E F G H I J K L M N O P " * 20), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    bench = [(10, "Here " + ITEM), (11, "Exactly seven words make this item up"), (12, "too few words"), (13, None), (None, filler), (14, ""), (15, "1 2 3 4 5 6 7 8 9")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = {(1, 10, False), (2, 10, True), (None, 10, True), (7, 10, True), (6, 11, False)}
    for limit in (32 << 20, 0):
        got = decontaminate.leaks(frame(spark, rows, True), b, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.item_id, r.reparameterised) for r in got} == want and len(got) == 5
        kept = decontaminate.clean(frame(spark, rows, True), b, broadcast_bytes=limit)
        assert kept.columns == frame(spark, rows, True).columns
        assert sorted(repr(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "8", "9"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, rows), empty).count() == 0
    assert decontaminate.clean(frame(spark, rows), empty).count() == len(rows)
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), b).count() == 0


def test_slots_must_agree():
    n = lambda k: k << 2 | decontaminate.NUMBER
    name = lambda k: k << 2 | decontaminate.NAME
    assert decontaminate.agreement([(0, [0, name(1), 0], [0, name(9), 0]), (3, [0, name(1), n(3)], [0, name(9), n(4)])]) == (6, True)
    assert decontaminate.agreement([(0, [0, name(1), 0], [0, name(9), 0]), (3, [0, name(1), 0], [0, name(8), 0])]) == (3, True)
    assert decontaminate.agreement([(0, [0, name(1), 0], [0, name(9), 0]), (3, [0, name(2), 0], [0, name(9), 0])]) == (3, True)
    assert decontaminate.agreement([(0, [n(1)], [n(9)]), (1, [n(2)], [n(9)])]) == (2, True)
    assert decontaminate.agreement([(0, [n(1)], [n(1)])]) == (1, False)


def test_a_consistent_copy_covers_more_than_an_inconsistent_one(spark):
    b = spark.createDataFrame([(1, "So " + ITEM)], "item_id long, text string")
    rows = decontaminate.leaks(frame(spark, [(1, OTHER), (2, WRONG)]), b, share=0.1).collect()
    got = {r.doc_id: r.covered for r in rows}
    assert got[1] > got[2]


def test_copies_of_an_item_with_different_values_are_judged_one_by_one(spark):
    import re

    filler = " . some plain words stand here before and after all of the rest . "
    text = "So " + ITEM

    def variant(k):
        names = {"Alice": f"Q{chr(97 + k)}", "Bob": f"V{chr(97 + k)}"}
        return re.sub(r"Alice|Bob|\d+", lambda m: names.get(m[0]) or str((int(m[0]) * (37 * k + 11)) % 97 + 100 * k), text)

    page = [variant(k) for k in range(1, 11)]
    edited = [v.replace("of the fruit", "of all the very fine fruit") for v in page]
    rows = [(1, filler.join(page)), (2, filler.join([*page[:5], text, *page[5:]])), (3, " ".join(page)), (4, filler.join(edited)), (5, filler * 9)]
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(frame(spark, rows), b).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[d].covered for d in (1, 2, 3)] == [got[1].item_tokens] * 3
    assert [got[d].reparameterised for d in (1, 2, 3, 4)] == [True, False, True, True]


def test_names_that_open_sentences_are_replaced(spark):
    item = "Alice has 12 apples. Bob gives Alice 5 more. Tom eats 3 of them. How many apples remain?"
    other = "Carla has 31 apples. Dan gives Carla 8 more. Raj eats 4 of them. How many apples remain?"
    inside = "It is said that Carla has 31 apples. Dan gives Carla 8 more. Raj eats 4 of them. How many apples remain?"
    mixed = "Carla has 31 apples. Dan gives Zoe 8 more. Zoe eats 4 of them. Why do apples remain?"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (32 << 20, 0):
        got = decontaminate.leaks(frame(spark, [(1, other), (2, inside), (3, item), (4, mixed)]), b, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.covered, r.reparameterised) for r in got} == {(1, 18, True), (2, 18, True), (3, 18, False)}


def test_items_of_few_words_are_found_as_they_stand(spark):
    bench = [(1, "Compute 12 * 3 + 45 / 9 - 7 * 8 + 16 * 2 - 4 / 2"), (2, "Ada Bob Cy Di Ed Flo Gus Hal Ida Jo"), (3, "three short words"), (4, "3 1 4 1 5 9 2 6 5 3"), (5, "7 + 8"), (6, "9 km Bo 4 m")]
    rows = [(10 + i, "We now say: " + x + " and so on.") for i, x in bench] + [(20 + i, x) for i, x in bench]
    rows += [(31, "Compute 13 * 3 + 46 / 9 - 7 * 9 + 16 * 3 - 4 / 3"), (32, "short three words"), (34, "1 " + bench[3][1] + " 8"), (35, "7 + 8 + 9"), (36, "7 + 9")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (32 << 20, 0):
        got = decontaminate.leaks(frame(spark, rows), b, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(k + i, i) for i, _ in bench for k in (10, 20)}
        assert not any(r.reparameterised for r in got)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    names, nouns, units = ["Ann", "Bert", "Cleo", "Élan", "Otto"], ["apples", "pears", "books", "trains", "coins"], ["km", "hours", "kg", "dollars"]
    verbs = ["has", "buys", "sells", "finds", "gives away", "counts"]
    number = lambda: rng.choice([str(rng.randint(2, 99)), "twelve", "seven", "3.5"])

    def question(fill):
        parts = [lambda: f"{fill('n')} {fill('v')} {fill('#')} {fill('o')} in the {fill('a')} market", lambda: f"then {fill('n')} walks {fill('#')} {fill('u')} to the {fill('a')} shop with {fill('n')}", lambda: f"how many {fill('o')} are left after {fill('#')} days"]
        return ". ".join(p() for p in parts) + "?"

    def filler(kinds):
        made, at = {}, Counter()

        def fill(k):
            at[k] += 1
            return made.setdefault((k, at[k] % 3), kinds[k]())

        return fill

    kinds = {"n": lambda: rng.choice(names), "v": lambda: rng.choice(verbs), "#": number, "o": lambda: rng.choice(nouns), "u": lambda: rng.choice(units), "a": lambda: rng.choice(["old", "new", "small"])}
    items, docs = [], []
    for i in range(8):
        text = question(filler(kinds))
        items.append((i, text))
        docs.append((100 + i, f"some plain words stand here. {text} and here too"))
        swap = dict(zip(names, rng.sample(names, len(names))))
        other = " ".join(swap.get(w, w) if w.isalpha() else w for w in text.split(" "))
        docs.append((200 + i, " ".join(str(rng.randint(100, 999)) if w.isdigit() else w for w in other.split(" "))))
        docs.append((300 + i, " ".join(rng.sample(text.split(" "), len(text.split(" "))))))
    items += [(50, "12 + 7 - 3 = 16"), (51, "short one"), (52, ""), (53, None)]
    docs += [(400, "so 12 + 7 - 3 = 16 it is"), (401, "a short one here"), (402, None), (403, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(frame(spark, docs), b).collect()}
    assert got == want
    assert {(100 + i, i) for i in range(8)} | {(400, 50), (401, 51)} <= got.keys() and len(got) > 14


def test_spelled_numbers_are_numbers(spark):
    b = spark.createDataFrame([(1, "On the farm Alice has twelve apples and seven pears and eats 3 of them")], "item_id long, text string")
    docs = [(1, "On the farm Carla has 31 apples and nine pears and eats four of them"), (2, "one plain text about nothing much at all in here")]
    assert [(r.doc_id, r.reparameterised) for r in decontaminate.leaks(frame(spark, docs), b).collect()] == [(1, True)]


def test_templates_equal_a_plain_reading():
    import re

    import pyarrow as pa

    text = "Paris fell. Then Marie walked 3.5 km. It took Élodie 1,000 minutes: No Km was lost! 7kg x2 Of\nAnd"
    t, _ = next(decontaminate.templates(pa.array([text])))
    kinds = [int(x & np.uint64(3)) for x in t.slot]
    tokens = re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text)
    assert tokens == "Paris fell Then Marie walked 3.5 km It took Élodie 1,000 minutes No Km was lost 7 kg x 2 Of And".split()
    assert kinds == [0, 0, 0, 2, 0, 1, 3, 0, 0, 2, 1, 3, 0, 2, 0, 0, 1, 3, 0, 1, 2, 0]


@pytest.mark.parametrize("capacity", [7, 50])
def test_packing_bins_and_bounds(spark, capacity):
    rows = rows_of(10)
    got = packing.pack(frame(spark, rows, True), capacity, partition_docs=20).collect()
    n = {}
    for d, t in rows:
        n.setdefault(d, []).append(len(brute.words(t)))
    back = {}
    for r in got:
        back[r.doc_id] = back.get(r.doc_id, 0) + r.n_tokens
        assert 1 <= r.n_tokens <= capacity and r.bound <= r.bins and r.start_word == r.piece * capacity
    assert back == {d: sum(v) for d, v in n.items() if sum(v)}
    bins = {}
    for r in got:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert max(bins.values()) <= capacity
    parts = {r.bin_id >> 20: r for r in got}
    assert sum(r.bins for r in parts.values()) == len(bins)
    for p, r in parts.items():
        size = np.array([x.n_tokens for x in got if x.bin_id >> 20 == p])
        assert brute.best_fit_decreasing(size.tolist(), capacity) == r.bins
        assert r.bound == packing.lower_bound(size, capacity) >= -(-int(size.sum()) // capacity)


@pytest.mark.parametrize("capacity", [1, 7, 2048])
def test_packed_texts_are_the_documents(spark, capacity):
    rows = rows_of(14) + [(None, "same id, other text"), (7, "  lead\t and\ntail \n"), (7, "  lead\t and\ntail \n")]
    df = frame(spark, rows, True)
    got = packing.pack(df, capacity, partition_docs=20, texts=True).collect()
    assert sorted((repr(r.doc_id), r.piece, r.n_tokens, r.bin_id) for r in got) == sorted((repr(r.doc_id), r.piece, r.n_tokens, r.bin_id) for r in packing.pack(df, capacity, partition_docs=20).collect())
    assert all(len(brute.words(r.text)) == r.n_tokens for r in got)
    want = Counter()
    for d, t in rows:
        w = brute.words(t)
        at = 0
        for p in range(-(-len(w) // capacity)):
            end = len(t)
            if (p + 1) * capacity < len(w):
                end, k = at, 0
                import re

                for m in re.finditer("[^ \t\n\r\x0b\x0c]+", t[at:]):
                    if k == capacity:
                        end = at + m.start()
                        break
                    k += 1
            want[d, p, t[at:end]] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.text) for r in got) == want


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.pack(frame(spark, [(1, None), (2, "")])).count() == 0
    got = packing.pack(frame(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), 3).collect()
    assert len(got) == 3 and len({r.bin_id for r in got}) == 3


def test_bounds_never_exceed_the_best_packing():
    def best(size, capacity):
        def go(i, rooms):
            if i == len(size):
                return len(rooms)
            out = go(i + 1, rooms + [capacity - size[i]])
            for k, r in enumerate(rooms):
                if r >= size[i] and r not in rooms[:k]:
                    out = min(out, go(i + 1, rooms[:k] + [r - size[i]] + rooms[k + 1 :]))
            return out

        return go(0, [])

    rng = random.Random(4)
    tight = 0
    for _ in range(150):
        c = rng.randint(4, 30)
        size = sorted((rng.randint(1, c) for _ in range(rng.randint(1, 7))), reverse=True)
        bound, least = packing.lower_bound(np.array(size), c), best(size, c)
        assert bound <= least
        tight += bound == least
    assert tight > 120
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_exchange_saves_bins(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(20, 50)) for i in range(400)]
    one = packing.pack(frame(spark, rows), 100, partition_docs=10, rounds=0).select("bin_id").distinct().count()
    got = packing.pack(frame(spark, rows), 100, partition_docs=10).collect()
    bins = {}
    for r in got:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert 142 <= len(bins) < one and max(bins.values()) <= 100 and sum(bins.values()) == sum(len(t.split()) for _, t in rows)
    parts = {r.bin_id // packing.MOST_BINS: r for r in got}
    assert sum(r.bins for r in parts.values()) == len(bins)
    with pytest.raises(ValueError, match="partition_docs"):
        packing.pack(frame(spark, rows), partition_docs=1 << 20)


def trees(messages):
    """Paths by a plain walk: {(conv, leaf): (path of ids, score)}."""
    best = {}
    for c, m, p, role, text, score in messages:
        if c is None or m is None:
            continue
        k = (-(score or 0), role is not None, role or "", text is not None, text or "", p is not None, p or "")
        if (c, m) not in best or k < best[c, m][0]:
            best[c, m] = (k, p, role, text, score or 0)
    kids = {}
    for (c, m), (_, p, *_rest) in best.items():
        kids.setdefault((c, p if (c, p) in best else None), []).append(m)
    out = {}

    def walk(c, m, path, score):
        path, score = [*path, m], score + best[c, m][4]
        if (c, m) not in kids:
            out[c, m] = path, score
        for k in kids.get((c, m), []):
            walk(c, k, path, score)

    for (c, p), ms in list(kids.items()):
        if p is None:
            for m in ms:
                walk(c, m, [], 0)
    return out, best


def test_reply_trees_equal_a_plain_walk(spark):
    rng = random.Random(11)
    rows = [(c, f"m{i}", f"m{rng.randrange(i)}" if i else None, rng.choice(["user", "assistant"]), f"text {i}", rng.randint(0, 3)) for c in range(6) for i in range(rng.randint(1, 25))]
    rows += [(7, "a", None, None, None, None), (7, "b", "a", "user", "", 1), (7, "b", "a", "user", "", 1), (7, "b", "a", "user", "z", 1), (8, "x", "y", "user", "cycle", 1), (8, "y", "x", "user", "cycle", 1), (8, "z", "gone", "user", "orphan", 1), (None, "q", None, "user", "t", 1), (9, None, None, "user", "t", 1), (10, "s", "s", "user", "self", 1)]
    rows += [(11, f"d{i}", f"d{i - 1}" if i else None, "user", "long " * 500, 1) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, msg_id string, parent_id string, role string, text string, score int, path int, at string")
    want, best = trees(rows)
    got = {(r.conv_id, r.leaf_id): r for r in reply_trees.conversations(df).collect()}
    assert got.keys() == want.keys()
    for (c, leaf), (path, score) in want.items():
        r = got[c, leaf]
        said = "".join(f"<|im_start|>{best[c, m][2] or 'user'}\n{best[c, m][3] or ''}<|im_end|>\n" for m in path)
        assert (r.n_turns, r.path_score, r.formatted) == (len(path), score, said)
        assert r.branch_rank == 1 + sum((-s, x) < (-score, leaf) for (d, x), (_, s) in want.items() if d == c)
    top = reply_trees.conversations(df, top=1).collect()
    assert len(top) == len({c for c, _ in want}) and all(r.branch_rank == 1 for r in top)


def test_turns_get_parents(spark):
    turns = [(1, 0, "user", "a"), (1, 2, "user", "bb"), (1, 2, "assistant", "ccc"), (1, 2, "assistant", "ccc"), (1, 3, "user", None), (2, None, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, score int")
    got = {(r.msg_id, r.parent_id, r.text) for r in reply_trees.with_parents(df).collect()}
    assert got == {("0.0", None, "a"), ("2.0", "0.0", "ccc"), ("2.1", "0.0", "bb"), ("3.0", "2.0", None)}
    out = {r.leaf_id: r.n_turns for r in reply_trees.conversations(reply_trees.with_parents(df)).collect()}
    assert out == {"2.1": 2, "3.0": 3}
    empty = df.where("false")
    assert reply_trees.conversations(reply_trees.with_parents(empty)).collect() == []



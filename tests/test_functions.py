import pytest
from pyspark.sql import functions as F

from lexspan.functions import citations, text
from lexspan.operators import chunking, logs, references


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_citations(spark):
    cases = {
        "section 1813 of title 12, United States Code": ("12", "1813", None, None, None, None),
        "12 U.S.C. 2000a-4": ("12", "2000a", None, None, None, None),
        "12 U.S.C.": ("12", None, None, None, None, None),
        "title 5 of the United States Code": ("5", None, None, None, None, None),
        "title 5, United States Code": ("5", None, None, None, None, None),
        "14 C.F.R. § 39.5": (None, None, "14", "39", "39.5", None),
        "14 C.F.R. Part 39": (None, None, "14", "39", None, None),
        "14 C.F.R. 39.5": (None, None, "14", None, None, None),
        "Part 39 of 14 C.F.R.": (None, None, "14", None, None, None),
        "14 CFR part 39": (None, None, None, None, None, "39"),
        "sections 5 and 6 of title 12": None,
        "": None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "ref_id long, ref_text string")
    got = {r.ref_text: r for r in references.parsed(rows).collect()}
    for t, want in cases.items():
        r = got[t]
        assert (None if r.form is None else (r.usc_title, r.usc_section, r.cfr_title, r.cfr_part, r.cfr_section, r.part_only)) == want, t


def test_boundaries(spark):
    pairs = [("234", "23"), ("2000a-4", "2000a"), ("12(b)", "12"), ("1813a", "1813"), ("ab", "a"), ("a(1)", "a"), ("56", "56"), ("x", "")]
    two = "cited string, candidate string"
    c, d = F.col("cited"), F.col("candidate")
    assert values(spark, citations.designator_prefix(c, d), pairs, two) == [False, True, True, True, False, False, True, False]
    pairs = [("56(g)", "56"), ("9E003.a.8", "9E003"), ("567", "56"), ("56", "56")]
    assert values(spark, citations.enclosing_prefix(c, d), pairs, two) == [True, True, False, False]
    assert values(spark, citations.plain_prefix(c, d), [("567(a)", "56")], two) == [True]


def test_emphasis(spark):
    cases = {'**"term"**': "term", "_x_": "x", "**": "", "term*": "term*", "term's": "term's", "__t__": "t", " 'q' ": "q", "*": "*", '"': '"'}
    assert values(spark, text.strip_emphasis(F.col("x")), list(cases)) == list(cases.values())


def test_cleaning(spark):
    assert values(spark, text.clean_text(F.col("x")), ["“a”\xa0b—c\n\t d\n\n\ne", "\n\nx\n", "so\xadft &ndash; y"]) == ['"a" b--c d\ne', "x", "soft - y"]
    assert values(spark, text.clean_summary_text(F.col("x")), ["-- a summary \n"]) == ["a summary"]


def test_terms(spark):
    assert values(spark, text.normalize_term(F.col("x")), ["board", "The Board", "an apple", "A", "the", " a  b ", None]) == ["board", "board", "apple", "a", "the", "b", ""]
    assert values(spark, text.plural_of(F.col("x")), ["appendix", "category", "Policy"]) == ["appendices", "categorys", "policys"]
    assert values(spark, text.strip_sub_prefix(F.col("x")), ["subsection", "Sub-part", "section"]) == ["section", "part", "section"]


def test_questions(spark):
    rows = [("a", "what is a thing?"), ("Is the long question over twenty words?", "is the LONG question over twenty words"), ("one two three four five six", "one two three four five sevens"), ("x", "yy")]
    assert values(spark, text.same_question(F.col("p"), F.col("q")), rows, "p string, q string") == [True, True, True, False]


def test_lists_and_sizes(spark):
    a = F.col("x")
    assert values(spark, text.oxford_list(a), [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>") == ["", "a", "a and b", "a, b, and c"]
    assert values(spark, text.file_size(a), [(512,), (2048,), (3 * 1024**2,)], "x long") == ["512 B", "2.0 KB", "3.0 MB"]
    assert values(spark, text.truncate(a, 5), ["abc", "abcdefg"]) == ["abc", "ab..."]
    assert values(spark, text.filter_map(a), ["k=v,l=w"]) == [{"k": "v", "l": "w"}]
    assert values(spark, text.drop_unbalanced_brackets(a), ["[a", "a]", "[a]"]) == ["a", "a", "[a]"]
    assert values(spark, text.indent_of_identifier(a), ["/us/usc/t1/s2"]) == [4]


def test_chunks_at_white_space():
    assert [len(c) for c in chunking.chunk("a" * 100 + "\n\n" + "b" * 10, [], 20)] == [100, 10]
    assert chunking.chunk("", [], 5) == [] and chunking.chunk("abc", [], 0) == ["abc"]
    assert [len(c) for c in chunking.chunk("x" * 25, [], 10)] == [10, 10, 5]
    assert [len(c) for c in chunking.chunk("a" * 30 + "b" * 30 + "c" * 30, [(60, 1), (30, 1)], 40)] == [40, 20, 30]


def test_chunks_by_level():
    t = "".join(chr(97 + i % 26) for i in range(100))
    points = [(20, 2), (40, 1), (60, 2), (80, 1)]
    out = chunking.chunk(t, points, 45)
    assert "".join(out) == t and out == [t[:40], t[40:80], t[80:]]
    assert chunking.chunk(t, points, 25) == [t[:20], t[20:40], t[40:60], t[60:80], t[80:]]


@pytest.mark.parametrize("limit", [1, 7, 50, 400])
def test_strict_chunks_lose_nothing(limit):
    import random

    rng = random.Random(limit)
    for _ in range(50):
        t = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 300)))
        points = [(rng.randint(0, 300), rng.randint(1, 3)) for _ in range(rng.randint(0, 20))]
        spans = chunking.strict_spans(t, [p for p in points if p[0] <= len(t)], limit)
        assert "".join(t[a:b] for a, b in spans) == t and all(0 < b - a <= limit for a, b in spans)


def test_chunk_rows(spark):
    rows = spark.createDataFrame([("a", "x y z " * 10, [(6, 1)]), ("b", None, None), ("c", "", [])], "id string, t string, bp array<struct<pos:int,prio:int>>")
    got = chunking.chunks(rows, F.col("id"), F.col("t"), F.col("bp"), 20).orderBy("seq").collect()
    assert {r.key for r in got} == {"a"} and "".join(r.chunk for r in got) == "x y z " * 10
    assert [(r.start, r.end) for r in got][0] == (0, 6)


def test_blank_lines_go():
    assert chunking.drop_blank_lines("a\n \nb\n", [(0, 1), (3, 2), (5, 1)]) == ("a\nb\n", [(0, 1), (3, 1)])


def test_breakpoints(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 3, 1), (1, 5, 1)], "k int, pos int, prio int")
    assert [tuple(b) for b in chunking.best_breakpoints(rows, ["k"]).first()["breakpoints"]] == [(3, 1), (5, 1)]
    lines = spark.createDataFrame([(1, 0, "head"), (1, 1, "(a) one"), (1, 2, "two")], "k int, ord int, text string")
    r = chunking.assemble(lines, ["k"]).first()
    assert r["text"] == "head\n(a) one\ntwo" and [tuple(b) for b in r["breakpoints"]] == [(5, 1), (13, 2)]


def test_tasks(spark):
    prompts = ["please extract **defined terms** now", "trying to find a definition for the term: x", "z" * 900 + "extract **defined terms**", "earlier analysis ... was found to be defined as", ""]
    assert values(spark, logs.task_of(F.col("x")), prompts) == ["s2.extract_terms", "s2.retry_extraction", None, "s2.evaluate_quality", None]

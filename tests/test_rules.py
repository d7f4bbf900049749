"""Model calls, status, queues and parsers; and the newer queries against their SQL."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexspan.functions import citations, text
from lexspan.operators import analysis, jobs, model, ranking, status, tree
from lexspan.plans import markup_queries, rule_queries, stream_queries
from lexspan.sources import markup

DATA = Path("/root/testdata/sf0.001")


class Counting(model.Stub):
    """Notes every call in a file, from whatever process it comes."""

    def __init__(self, path):
        self.path = path

    def ask(self, context, prompt):
        with open(self.path, "a") as f:
            f.write(json.dumps([context, prompt]) + "\n")
        return super().ask(context, prompt)

    def calls(self):
        return [tuple(json.loads(x)) for x in open(self.path)]


def none(spark):
    return spark.createDataFrame([], "key string, response string")


def test_each_different_call_is_made_once(spark, tmp_path):
    m = Counting(f"{tmp_path}/calls")
    calls = spark.createDataFrame([("c", "p"), ("c", "p"), ("c", "q")], "full_cache string, prompt string")
    got, full = model.answered(calls, none(spark), m, ["score"])
    assert got.count() == 3 and full.count() == 2 and len(got.collect()) == 3
    assert sorted(m.calls()) == [("c", "p"), ("c", "q")]
    again, _ = model.answered(calls, full, m, ["score"])
    assert again.count() == 3 and len(m.calls()) == 2


def test_analysis_works_its_queue_off(spark, tmp_path):
    m = Counting(f"{tmp_path}/calls")
    units = spark.createDataFrame([("unit", str(i), f"summary {i}") for i in range(32)], "type_key string, unit_id string, summary string")
    scores, facts, asked = model.analyse(units, "why?", m, none(spark))
    assert scores.count() == 32
    rows = asked.collect()
    assert len({r.unit_id for r in rows}) == len(rows)  # none twice
    calls = m.calls()
    assert len(set(calls)) == len(calls) == 32 + len(rows)
    score = {r.unit_id: r.score for r in scores.collect()}
    assert {u for u, s in score.items() if s >= 2} <= {r.unit_id for r in rows}
    assert {r.wave for r in rows} == set(range(max(r.wave for r in rows) + 1))
    found = facts.orderBy("ord").collect()
    assert [r.id for r in found] == [f"f{i:03d}" for i in range(1, len(found) + 1)] and len({r.content for r in found}) == len(found)
    wave = {r.unit_id: r.wave for r in rows}
    for context, prompt in calls[32:]:
        w = wave[prompt.split()[1]]
        assert context == "\n".join(["why?", *(f"[{r.id}] {r.content}" for r in found if r.wave < w)])
    answer = model.final_answer(facts, "why?", m, none(spark)).collect()
    assert len(answer) == 1 and len(answer[0].answer) == 12
    assert model.final_answer(facts.where("false"), "why?", m, none(spark)).first().answer == "Nothing was found."


def test_the_newest_facts_that_fit_are_told(spark):
    facts = spark.createDataFrame([(f"f{i:03d}", i, 0, "u", "x" * 10) for i in range(1, 9)], "id string, ord long, wave int, unit_id string, content string")
    assert model._told("q", facts, 40) == "q\n[f007] " + "x" * 10 + "\n[f008] " + "x" * 10
    assert model._told("q", facts.where("false"), 40) == "q"


def test_tools_look_up_one_document(spark):
    units = spark.createDataFrame([(1, "section", "4", "its text"), (2, "section", "4", "other")], "doc_id int, type_key string, unit_id string, text string")
    terms = spark.createDataFrame([(1, "The Act", "b"), (1, "act", "a"), (2, "act", "c")], "doc_id int, term string, value string")
    t = model.lookup_tools(units, terms, 1)
    assert (t["unit"]("section", "4"), t["definition"]("an ACT"), t["unit"]("section", "5")) == ("its text", "a\nb", "There is no such unit.")
    key = units.select(model.messages_key(F.array("text"), F.array(F.lit("t")), F.lit(None).cast("string"))).distinct().collect()
    assert len(key) == 2 and all(len(r[0]) == 64 for r in key)


def test_emphasis_goes_layer_by_layer(spark):
    layers = ['"' * 10 + "a" + '"' * 10, "\"'**_x_**'\"", '"open', "*", "", None, '" "in" "', "a 'b' c"]
    rows = spark.createDataFrame([(x,) for x in layers], "x string")
    assert [r[0] for r in rows.select(text.strip_emphasis(F.col("x"))).collect()] == ["a", "x", '"open', "*", "", None, "in", "a 'b' c"]


def test_citation_forms(spark):
    want = {
        "Section 1813a of Title 012": ("usc_of_title", "12", "1813a", None, None, None, None),
        "12 u.s.c. §§ 5": ("usc_section", "12", "5", None, None, None, None),
        "12 U.S.C.": ("usc_title", "12", None, None, None, None, None),
        "title 7, of the United  States Code": ("usc_code", "7", None, None, None, None, None),
        "14 C.F.R., § 39.5a": ("cfr_section", None, None, "14", "39", "39.5a", None),
        "14 C.F.R. Part 039": ("cfr_part", None, None, "14", "39", None, None),
        "14 C.F.R": ("cfr_title", None, None, "14", None, None, None),
        "see part 9": ("part", None, None, None, None, None, "9"),
        "parts of it": None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", citations.parse_citation(F.col("x")).alias("c"))
    for r in rows.collect():
        assert (None if r.c is None else tuple(r.c[k] for k in ("form", *citations.FIELDS))) == want[r.x], r.x


def test_batches_of_a_large_group(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("s"))
    got = {}
    for r in ranking.batches(rows, ["g"], "o", "s", 10, 100).orderBy("o").collect():
        got.setdefault(r.g, []).append(r)
    for mine in got.values():
        b = n = total = 0
        for r in mine:
            s = r.s or 0
            if n and (n >= 10 or total + s > 100):
                b, n, total = b + 1, 0, 0
            n, total = n + 1, total + s
            assert r.batch == b


def test_ranges_meet_only_what_lies_inside(spark):
    units = spark.createDataFrame([("d", "s", f"u{i % 7}", i * 1000) for i in range(20)], "doc_id string, type_key string, unit_id string, ord long")
    wanted = spark.createDataFrame([(1, "d", "s", "u2", "u5"), (2, "d", "s", "u5", "u2"), (3, "d", "s", "u2", "gone"), (4, "d", "s", "u3", "u3")], "range_id int, doc_id string, type_key string, first_id string, last_id string")
    got = {}
    for r in tree.ranges(units, wanted).collect():
        got.setdefault(r.range_id, []).append(r.ord // 1000)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3, 4, 5], 2: [2, 3, 4, 5], 4: [3]}
    got = {}
    for r in tree.ranges(units, wanted, parity=True).collect():
        got.setdefault(r.range_id, []).append(r.ord // 1000)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3, 4, 5], 2: [2, *range(5, 20)], 4: list(range(3, 20))}


def test_jobs_are_queued_once(spark):
    schema = "id long, status string, job_type string, file_path string, created_at timestamp, retry_count int, max_retries int, worker_id string"
    j = spark.createDataFrame([(3, "running", "parse", "./a//b", None, 0, 1, "w"), (4, "failed", "parse", "c", None, 0, 1, None)], schema)
    new = spark.createDataFrame([("parse", "a\\b", 1), ("parse", "c", 2), ("parse", "./c", 2), ("ask", "a/b", 3)], "job_type string, file_path string, max_retries int")
    got = jobs.enqueue(j, new, F.expr("TIMESTAMP '2026-01-01 00:00:00'"))
    assert got.columns == j.columns
    assert [(r.id, r.job_type, r.file_path, r.max_retries) for r in got.where("status = 'queued'").orderBy("id").collect()] == [(5, "ask", "a/b", 3), (6, "parse", "./c", 2)]
    empty = jobs.enqueue(j.where("false"), new, F.current_timestamp())
    assert sorted(r.id for r in empty.collect()) == [1, 2, 3]


def test_versions_and_processed_files(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", None)], "v string, t string")
    assert status.version_checked(rows, F.col("v"), "1").count() == 2
    with pytest.raises(Exception, match="version 1"):
        status.version_checked(rows, F.col("v"), "2").collect()
    assert [r[0] for r in rows.select(status.is_processed(F.col("v"), F.col("t"))).collect()] == [True, False]
    assert status.chunk_prefixes(rows.withColumn("chunk_prefix", F.col("t"))).count() == 1


def test_labels_of_a_pool(spark):
    pool = spark.createDataFrame([("s 1", None), ("s 1", ""), ("s 1", "Doc")], "unit_label string, external_doc_label string")
    assert sorted(r[0] for r in analysis.active_labels(pool).collect()) == ["Doc s 1", "s 1"]


def test_nested_sections_and_appendices():
    rows = markup.parse_uslm(b"<main><title><num value='1'/><section><num value='1'/><content>a</content><quotedContent><section><num value='x'/><content>b</content></section></quotedContent></section></title></main>")
    assert [(r["unit_path"], r["parent_unit_path"], r["depth"]) for r in rows] == [("section_1", None, 0), ("section_1/section_x", "section_1", 1)]
    with pytest.raises(ValueError, match="twice"):
        markup.parse_uslm(b"<main><section><num value='1'/></section><section><num value='1'/></section></main>")
    assert markup.parse_uslm(b"<main><title><num value='1'/><section><num value='1'/></section></title></main>", {"title": "2"}) == []
    assert [markup.appendix_of(x) for x in ("Supplement No. 1", "SFAR 7", "Appendix A", "Tables", "")] == [("supplement", "No. 1"), ("special federal aviation regulation", "7"), ("appendix", "A"), ("appendix", "Tables"), ("appendix", "")]


def one(x):
    import pandas as pd

    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(one, x))
    if isinstance(x, (bool, str)):
        return x
    if type(x).__name__ == "bool":
        return bool(x)
    if x is None or pd.isna(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("module", [markup_queries, rule_queries, stream_queries])
def test_queries_equal_their_sql(spark, module):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f if f.is_file() else f / '*.parquet'}')")
    assert module.QUERIES.keys() == module.ORACLES.keys()
    rows = lambda df: sorted(repr(tuple(map(one, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    for name, query in module.QUERIES.items():
        got, want = query(spark, str(DATA)).toPandas(), con.execute(module.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name

import datetime as dt

from pyspark.sql import functions as F

from lexspan.functions import citations
from lexspan.operators import cache, definitions, diff, jobs, markup_scan, model, ranking, references, tree

UNITS = [  # section 1; section 2 with an ECCN below it
    ("d", "section_1", None, "section", "1", 0, 0, "t"),
    ("d", "section_2", None, "section", "2", 1, 0, "t"),
    ("d", "section_2/eccn_0A001", "section_2", "eccn", "0A001", 2, 1, "t"),
]
SCHEMA = "doc_id string, unit_path string, parent_unit_path string, type_key string, unit_id string, ord long, depth int, text string"


def test_leaves_and_nodes(spark):
    u = spark.createDataFrame(UNITS, SCHEMA)
    types = spark.createDataFrame([("section", 1), ("eccn", 1)], "type_key string, operational int")
    assert sorted(r.unit_id for r in tree.leaves(u).collect()) == ["0A001", "1"]
    assert [r.unit_id for r in tree.operational(u, types).orderBy("ord").collect()] == ["1", "2", "0A001"]
    assert [r.unit_id for r in tree.containers(u).collect()] == ["2"]


def test_longest_prefix(spark):
    ids = spark.createDataFrame([("section", x) for x in ("5", "56", "57", "60")] + [("eccn", "9E003")], "type_key string, designator string")
    cited = spark.createDataFrame([("section", "56(g)"), ("eccn", "9E003.a.8"), ("section", "567"), ("section", "60")], "type_key string, cited string")
    got = {r.cited: r.matched for r in tree.longest_prefix(cited, ids, citations.enclosing_prefix, ["type_key"]).collect()}
    assert got == {"56(g)": "56", "9E003.a.8": "9E003", "567": None, "60": "60"}
    got = {r.cited: r.matched for r in tree.longest_prefix(cited, ids, citations.plain_prefix, ["type_key"]).collect()}
    assert got["567"] == "56"


def test_ranges(spark):
    u = spark.createDataFrame([("d", "section", x, i) for i, x in enumerate(["5", "56", "57", "9E003", "60"])], "doc_id string, type_key string, unit_id string, ord int")
    w = spark.createDataFrame([(1, "d", "section", "5", "57"), (2, "d", "section", "57", "5"), (3, "d", "section", "5", "5"), (4, "d", "section", "5", "99")], "range_id int, doc_id string, type_key string, first_id string, last_id string")

    def run(parity):
        out = {}
        for r in tree.ranges(u, w, parity).orderBy("ord").collect():
            out.setdefault(r.range_id, []).append(r.unit_id)
        return out

    assert run(False) == {1: ["5", "56", "57"], 2: ["5", "56", "57"], 3: ["5"]}
    assert run(True) == {1: ["5", "56", "57"], 2: ["5", "57", "9E003", "60"], 3: ["5", "56", "57", "9E003", "60"]}


def test_splits(spark):
    step = lambda *x: list(x)
    rows = [(1, "uslm", step(("title", "1"))), (2, "uslm", step(("title", "1"), ("chapter", "2"))), (3, "uslm", step(("title", "1"), ("chapter", "2"), ("part", "3"))), (4, "cfr", step(("title", "1"), ("part", "9"))), (5, "uslm", [])]
    c = spark.createDataFrame(rows, "doc_id long, parser_type string, content_scope array<struct<type:string,id:string>>")
    assert sorted(map(tuple, references.splits(c).collect())) == [(1, 2, "chapter"), (2, 3, "part")]


def test_stage_and_stem(spark):
    rows = [(1, "/a/x_parse_output.json", 1), (2, "/a/x_processed.json", 3), (3, "/b/x_processed.json", 2), (4, "/a/y.json", None)]
    d = spark.createDataFrame(rows, "doc_id long, file_path string, stage_reached int")
    assert sorted(r.doc_id for r in references.highest_stage(d).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in references.highest_stage(d, by_folder=False).collect()) == [2, 4]


def test_references_are_added_once(spark):
    s = "ref_id long, source_doc_id long, source_item_type string, source_item_number string, ref_text string, ref_context string, term string"
    known = spark.createDataFrame([(1, 1, "section", "1", "x", "need_ref", None), (2, 1, "section", "1", "x", "definition", None)], s)
    found = spark.createDataFrame([(3, 1, "section", "1", "x", "need_ref", "t"), (4, 1, "section", "1", "x", "definition", None), (5, 1, "section", "1", "x", "definition", "t")], s)
    assert sorted(r.ref_id for r in references.add_references(known, found).collect()) == [1, 2, 5]


def test_type_hints(spark):
    refs = spark.createDataFrame([(1, "12 U.S.C. 1"), (2, "something")], "ref_id long, ref_text string")
    docs = spark.createDataFrame([(10, "uslm"), (11, "cfr")], "doc_id long, parser_type string")
    assert sorted(map(tuple, references.type_hint(refs, docs).collect())) == [(1, 10), (2, 10), (2, 11)]


def test_push_down(spark):
    rows = [(1, "A", None, "title_1/chapter_1"), (2, "B", None, "title_1/chapter_2"), (3, "A", "in this title", "title_1/chapter_1")]
    d = spark.createDataFrame([("d", i, "", t, v, s, p) for (i, v, s, p), t in zip(rows, ("Board", "the board", "Other"))], "doc_id string, def_id long, location_path string, term string, value string, scope string, source_path string")
    got = {r.def_id: (r.location_path, r.n_moves) for r in definitions.push_down(d).collect()}
    assert got == {1: ("title_1/chapter_1", 2), 2: ("title_1/chapter_2", 2), 3: ("", 0)}


def test_scoped(spark):
    u = spark.createDataFrame([("d", "section_1", "title_1/chapter_2")], "doc_id string, unit_path string, org_path string")
    d = spark.createDataFrame([("d", i, p, "T", str(i), "direct") for i, p in enumerate(["", "title_1", "title_1/chapter_2", "title_1/chapter_3", "section_1"])], "doc_id string, def_id long, location_path string, term string, value string, def_kind string")
    s = definitions.scoped(u, d)
    assert sorted((r.def_id, r.org_depth) for r in s.collect()) == [(0, -1), (1, 0), (2, 1), (4, 999)]
    assert [r.def_id for r in definitions.most_specific(s).collect()] == [4]


def test_batches(spark):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate([5000, 4000, 2000, 20000, 1] + [1] * 12)], "q string, ord int, size int")
    got = [r.batch for r in ranking.batches(rows, ["q"], "ord", "size").orderBy("ord").collect()]
    assert got == [0, 0, 1, 2, 3] + [3] * 9 + [4] * 3


def test_budget_and_facts(spark):
    f = spark.createDataFrame([("q", f"f{i:03d}", "x" * 50, ["s 1"]) for i in range(20)], "q string, id string, content string, source_units array<string>")
    assert ranking.fact_pool(f, ["q"], 10_000).count() == 20
    got = sorted(r.id for r in ranking.fact_pool(f, ["q"], 300).collect())
    assert got == ["f017", "f018", "f019"]
    assert ranking.within_budget(f, ["q"], "id", F.length("content"), 100).count() == 2


def test_neighbours(spark):
    p = spark.createDataFrame([("q", 1, "the cat sat on the mat")], "question_id string, prop_id int, content string")
    pool = spark.createDataFrame([("q", 1, "The cat sat on the mat."), ("q", 2, "nothing alike here"), ("q", 3, "the cat sat on a mat"), ("r", 4, "the cat sat on the mat")], "question_id string, item_id int, content string")
    got = ranking.neighbours(p, pool).orderBy("rank").collect()
    assert [r.item_id for r in got] == [1, 3]


def test_questions_run_out(spark):
    q = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "answered")], "question_id string, status string")
    seen = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1")], "question_id string, unit_label string")
    active = spark.createDataFrame([("s1",), ("s2",)], "unit_label string")
    assert [r.question_id for r in ranking.exhausted(q, seen, active).collect()] == ["a"]
    assert [r.question_id for r in ranking.unseen(q, seen, "s2").collect()] == ["b"]


def test_facts_merge(spark):
    f = spark.createDataFrame([("q", "A  fact", ["x"], 1), ("q", "a fact", ["y", "x"], 2)], "question_id string, content string, source_units array<string>, ord int")
    r = ranking.merged_sources(f).collect()
    assert [(x.content, x.source_units) for x in r] == [("A  fact", ["x", "y"])]
    assert ranking.with_ids(f, ["question_id"], "ord", "f").orderBy("ord").first()["id"] == "f001"


T = dt.datetime(2026, 1, 1)
JOBS = "id long, status string, job_type string, file_path string, created_at timestamp, completed_at timestamp, started_at timestamp, worker_id string, error_message string, retry_count int, max_retries int"


def queue(spark):
    rows = [(1, "queued", 2), (2, "queued", 1), (3, "running", 0), (4, "completed", 50), (5, "failed", 1), (6, "cancelled", 90)]
    return spark.createDataFrame([(i, s, "parse", f"./a//f{i}", T - dt.timedelta(days=d), T - dt.timedelta(days=d) if s in ("completed", "failed", "cancelled") else None, None, None, None, 0, 1) for i, s, d in rows], JOBS)


def test_queue(spark):
    j, now = queue(spark), F.lit(T)
    assert jobs.next_job(j).first()["id"] == 1
    claimed = {r.id: r.status for r in jobs.claim(j, "w", now).collect()}
    assert claimed[1] == "running" and claimed[2] == "queued"
    ids = spark.createDataFrame([(3, "boom")], "id long, error_message string")
    once = jobs.failed(j, ids, now)
    r = once.where("id = 3").first()
    assert (r.status, r.retry_count, r.error_message, r.completed_at) == ("queued", 1, "boom", None)
    r = jobs.failed(once, ids, now).where("id = 3").first()
    assert (r.status, r.retry_count) == ("failed", 1)
    assert sorted(x.id for x in jobs.without_old(j, now).collect()) == [1, 2, 3, 5, 6]
    assert jobs.stale_cancelled(j, now).where("id = 3").first()["status"] == "cancelled"
    assert {x.id: x.status for x in jobs.cancelled(j, ids, now).collect()}[3] == "cancelled"
    assert {x.status: x.n_jobs for x in jobs.queue_stats(j).collect()} == {"queued": 2, "running": 1, "completed": 1, "failed": 1, "cancelled": 1}
    wanted = spark.createDataFrame([("a\\f1", "parse"), ("a/f4", "parse")], "file_path string, job_type string")
    assert [x.file_path for x in jobs.active(j, wanted).collect()] == ["a\\f1"]


def test_cache(spark):
    calls = cache.with_key(spark.createDataFrame([("c", "p", "m", 0), ("c", "p", "m", 0), (None, "q", "m", 0)], "full_cache string, prompt string, model string, max_tokens int"))
    import hashlib

    key = hashlib.sha256(b"c\n\n---QUERY---\n\np\n\n---MODEL---\n\nm\n\n---MAX_TOKENS---\n\n0").hexdigest()
    main = spark.createDataFrame([(key, "yes")], "key string, response string")
    assert cache.misses(calls, main).count() == 1
    assert sorted(str(r.response) for r in cache.answers(calls, main).collect()) == ["None", "yes", "yes"]
    text = spark.createDataFrame([('{"%s": {"response": "a \\"b\\""}, "%s": {"resp' % (key, key[::-1]),)], "value string")
    assert [(r.key, r.response) for r in cache.salvaged(text).collect()] == [(key, 'a "b"')]


def test_diff(spark):
    s = "p string, text string, notes map<string,string>"
    new = diff.signed(spark.createDataFrame([("a", "x", {}), ("b", "y", {"1": "n"}), ("c", "z", {})], s))
    old = diff.signed(spark.createDataFrame([("a", "x", {}), ("b", "y", {}), ("d", "w", {})], s))
    assert sorted((r.p, r.change) for r in diff.compared(new, old, ["p"]).collect()) == [("b", "modified"), ("c", "added"), ("d", "removed")]


def test_model_calls_are_cached(spark):
    calls = spark.createDataFrame([("c", "p"), ("c", "p"), ("c", "q")], "full_cache string, prompt string")
    none = spark.createDataFrame([], "key string, response string")
    got, full = model.answered(calls, none, model.Stub(), ["score"])
    assert full.count() == 2 and got.where("response IS NULL").count() == 0
    units = spark.createDataFrame([("section", str(i), f"summary {i}") for i in range(20)], "type_key string, unit_id string, summary string")
    scores, facts, _ = model.analyse(units, "why?", model.Stub(), none)
    assert {r.score for r in scores.collect()} <= {0, 1, 2, 3} and facts.count() >= 0

    class Bad:
        tries = 0

        def ask(self, context, prompt):
            self.tries += 1
            return "no json" if self.tries < 3 else 'well: {"score": 2}'

    assert model.ask_json(Bad(), "", "p", ["score"]) == '{"score":2}'
    assert model.ask_json(Bad(), "", "p", ["other"], tries=3) is None
    assert model.with_tools(lambda said: {"tool": "look", "args": {"x": 1}} if len(said) == 1 else {"text": said[-1]["content"]}, "q", {"look": lambda x: f"got {x}"}) == "got 1"
    assert [r[0] for r in spark.createDataFrame([("merge",), (None,)], "v string").select(model.gated(F.col("v"), "close_fact")).collect()] == ["merge", "merge"]


def test_large_tables(spark):
    big = "<table><caption>C</caption><tr><th>h</th></tr>" + "<tr><td>x</td></tr>" * 29 + "</table>"
    d = spark.createDataFrame([(1, f"a {big} b <table><tr></tr></table>")], "id int, text string")
    r = markup_scan.large_tables(d, ["id"], "text").collect()
    assert [(x.table_key, x.row_count, x.caption, x.headers) for x in r] == [("1", 30, "C", ["h"])]
    assert d.select(markup_scan.with_placeholders(F.col("text"))).first()[0] == "a [Table 1 extracted as sub-unit table 1] b <table><tr></tr></table>"
    e = spark.createDataFrame([(1, "pre **1A001 x **2B002 y")], "id int, text string")
    assert [(r.pos, r.name) for r in markup_scan.eccn_marks(e, ["id"], "text").orderBy("pos").collect()] == [(4, "1A001"), (14, "2B002")]

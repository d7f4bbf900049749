from pyspark.sql import functions as F

from lexspan.operators import analysis, units


def test_actions(spark):
    r = spark.createDataFrame([(1, '{"actions": [{"action": "add_entry", "entry": {"id": "1", "type": "fact", "content": "F"}}, {"action": "add_answer", "question_id": "q", "answer": {"id": "2", "content": "A"}}]}'), (2, 'So: ```json\n{"actions": [{"action": "request_detail", "id": "3", "target_type": "section", "target_number": "5"}]}```'), (3, '[{"action": "add_entry", "entry": {"type": "question", "content": "Q"}}]'), (4, '{"action": "add_entry", "entry": {"type": "odd", "content": "O"}}'), (5, "nothing"), (6, None)], "n int, response string")
    a = analysis.actions(r, ["n"])
    got = [(x.n, x.kind, x.content) for x in analysis.entries(a, ["n"]).orderBy("n", "ord").collect()]
    assert got == [(1, "fact", "F"), (1, "answer", "A"), (2, "request", "section 5"), (3, "question", "Q"), (4, "fact", "O")]


def test_compaction(spark):
    b = spark.createDataFrame([(1, "A  fact"), (1, "gone")], "n int, content string")
    a = spark.createDataFrame([(1, "a fact"), (1, "new")], "n int, content string")
    assert sorted((x.content, x.change) for x in analysis.compaction(b, a, ["n"]).collect()) == [("gone", "dropped"), ("new", "made")]


def test_cross_document_units(spark):
    refs = spark.createDataFrame([("Section", "1", "e", "section", "9"), ("section", "2", "e", "section", "8"), ("section", "1", "e", "section", "7")], "source_type string, source_number string, target_doc_id string, target_type string, target_number string")
    scores = spark.createDataFrame([("section", "1", 3), ("section", "2", 0)], "type_name string, unit_id string, score int")
    u = spark.createDataFrame([("e", "section", "9"), ("e", "section", "8")], "doc_id string, type_name string, unit_id string")
    known = spark.createDataFrame([("e", "section", "3", 1)], "doc_id string, type_name string, unit_id string, score int")
    assert sorted(map(tuple, analysis.cross_document_units(refs, scores, u, known).collect())) == [("e", "section", "3", 1), ("e", "section", "9", 2)]


def test_scored_levels(spark):
    rows = [("d", "a_1", None, 0), ("d", "a_1/b_1", "a_1", 1), ("d", "a_1/b_1/c_1", "a_1/b_1", 2), ("d", "a_2", None, 0), ("d", "a_2/b_1", "a_2", 1)]
    o = spark.createDataFrame(rows, "doc_id string, org_path string, parent_path string, depth int")
    own = spark.createDataFrame([("d", p, 0) for p in ("a_1", "a_1/b_1", "a_1/b_1/c_1")], "doc_id string, org_path string, score int")
    assert analysis.scored_levels(o, own).count() == 5
    assert sorted(r.org_path for r in analysis.scored_levels(o, own, prune="two_zero").collect()) == ["a_1", "a_1/b_1", "a_2", "a_2/b_1"]
    got = {r.org_path: r.score for r in analysis.scored_levels(o, own, scope="a_1/b_1").collect()}
    assert got == {"a_1": 1, "a_1/b_1": 0, "a_1/b_1/c_1": 0, "a_2": 0}


def test_targets(spark):
    u = spark.createDataFrame([(d, "section", str(i), i) for d in ("p", "q") for i in range(30) if d == "q" or i < 5], "doc_id string, type_key string, unit_id string, ord int")
    w = spark.createDataFrame([(1, "section", "1", "3"), (2, "section", "2", "25"), (3, "section", "99", "99")], "ref_id int, type_key string, first_id string, last_id string")
    got = analysis.targets(w, u, "p").collect()
    assert [(r.doc_id, r.unit_id) for r in sorted(got, key=lambda r: r.ord) if r.ref_id == 1] == [("p", "1"), ("p", "2"), ("p", "3")]
    assert len([r for r in got if r.ref_id == 2]) == 15 and {r.doc_id for r in got if r.ref_id == 2} == {"q"}


def test_duplicates(spark):
    rows = [("A", 0, ""), ("A", 1, "x"), ("A", 2, " "), ("A", 3, "y"), ("B", 4, ""), ("B", 5, None), ("C", 6, "z")]
    r = spark.createDataFrame([("d", *x) for x in rows], "doc_id string, unit_id string, ord int, text string")
    got = sorted((x.unit_id, x.ord) for x in units.duplicates_settled(r, ["doc_id"]).collect())
    assert got == [("A", 1), ("A_dup", 3), ("B", 4), ("C", 6)]


def test_suffix(spark):
    s = "doc_id string, type_key string, unit_id string, annotation string, notes array<struct<id:string,text:string>>"
    u = spark.createDataFrame([("d", "section", "1", "Old", []), ("d", "section", "1_dup", "New", [("1", "n"), ("2", "m")]), ("d", "section", "2", "Lone", []), ("d", "section", "3_dup", "", [])], s)
    got = {r.unit_id: r.suffix for r in units.metadata_suffix(u).collect()}
    assert got == {"1": "\n\n[ANNOTATION]: Old", "1_dup": "\n\n[ANNOTATION]: New\n\n[NOTES]: Note 1: n, Note 2: m", "2": "", "3_dup": ""}


def test_offsets(spark):
    t = spark.createDataFrame([("abcdef" * 200, "def", 600)], "t string, n string, o int")
    r = t.select(units.by_offset(F.col("t"), F.lit(2), F.lit(5)).alias("a"), units.by_offset(F.col("t"), F.lit(-1), F.lit(5)).alias("b"), units.near_offset(F.col("t"), F.col("n"), F.col("o")).alias("c")).first()
    assert (r.a, r.b) == ("cde", None) and ("abcdef" * 200)[r.c : r.c + 3] == "def" and 350 <= r.c <= 850


def test_work_list(spark):
    p = spark.createDataFrame([("a_parse_output.json",), ("b_parse_output.json",)], "path string")
    d = spark.createDataFrame([("a_processed.json", 3)], "path string, stage_reached int")
    assert [r.path for r in units.work_list(p, d, 2).collect()] == ["b_parse_output.json"] and units.work_list(p, d, 2, True).count() == 2
    f = spark.createDataFrame([("o", "x", "s1"), ("o", "x", "s2")], "folder string, stem string, source string")
    assert sorted(r.output for r in units.output_names(f).collect()) == ["x", "x_2"]
    i = spark.createDataFrame([("t", "i", "section", "2"), ("t", "i", "section", "1")], "issue_type string, issue string, item_type string, item_number string")
    assert units.issues(i).first()["items"] == ["section 1", "section 2"]
    assert spark.range(1).select(units.with_source(F.lit("v"), F.lit("section"), F.lit("1"), F.lit("section"), F.lit("2"))).first()[0] == "(from section 1) v"

import datetime as dt

from pyspark.sql import functions as F

from lexspan.operators import model, registry, rollup, scopes

ORGS = "doc_id string, org_path string, parent_path string, level_type string, level_id string, depth int, ord long"


def orgs(spark):
    rows = [("title_1", None), ("title_1/chapter_I", "title_1"), ("title_1/chapter_I/section_2", "title_1/chapter_I"), ("title_1/chapter_III", "title_1"), ("title_1/chapter_III/part_9", "title_1/chapter_III"), ("title_1/chapter_III/part_9/section_2", "title_1/chapter_III/part_9"), ("title_1/chapter_III/section_2", "title_1/chapter_III")]
    return spark.createDataFrame([("d", p, up, *p.split("/")[-1].split("_"), p.count("/"), i) for i, (p, up) in enumerate(rows)], ORGS)


def test_compound_paths(spark):
    s = "ref_id int, doc_id string, org_path string, elements array<struct<type:string,id:string>>"
    w = spark.createDataFrame([(1, "d", "title_1/chapter_I", [("chapter", "III"), ("section", "2")]), (2, "d", "title_1/chapter_I", [("section", "2")]), (3, "d", "title_1", [("chapter", "III"), ("section", "7")]), (4, "d", "title_1", [("chapter", "iii")]), (5, "d", "title_1", [])], s)
    got = {r.ref_id: r.found_path for r in scopes.compound(w, orgs(spark)).collect()}
    assert got == {1: "title_1/chapter_III/section_2", 2: "title_1/chapter_I/section_2", 3: None, 4: "title_1/chapter_III", 5: None}


def test_current(spark):
    c = spark.createDataFrame([([("title", "1"), ("chapter", "2")], "chapter"), ([("title", "1")], "part")], "c array<struct<type:string,id:string>>, k string")
    assert [r[0] for r in c.select(scopes.current(F.col("c"), F.col("k"))).collect()] == ["title_1/chapter_2", None]


def test_indirect(spark):
    s = "doc_id string, def_id long, location_path string, location_kind string, term string, value string, indirect_loc_path string"
    d = spark.createDataFrame([("d", 1, "s1", "unit", "The Board", "v", None), ("d", 2, "s2", "unit", "board", "", "s1"), ("d", 3, "s3", "unit", "board", "", "s3"), ("d", 4, "s4", "unit", "board", "", "s9")], s)
    got = {r.def_id: (r.value, r.location_kind) for r in scopes.indirect(d).collect()}
    assert got == {1: ("v", "unit"), 2: ("v", "unit"), 3: ("", "external")}


def test_rollup(spark):
    o = orgs(spark)
    u = spark.createDataFrame([("d", "title_1/chapter_I/section_2", 0, "only"), ("d", "title_1/chapter_III/section_2", 1, "a"), ("d", "title_1/chapter_III/section_2", 2, None)], "doc_id string, org_path string, ord long, summary_1 string")
    none = spark.createDataFrame([], "key string, response string")
    got = {r.org_path: r.summary_1 for r in rollup.summaries(o, u, none, model.Stub()).collect()}
    assert got["title_1/chapter_I/section_2"] == got["title_1/chapter_I"] == "only"
    assert "title_1/chapter_III/section_2" not in got and "title_1/chapter_III" not in got
    full = rollup.summaries(o, u.fillna("b", ["summary_1"]), none, model.Stub())
    got = {r.org_path: r.summary_1 for r in full.collect()}
    assert len(got["title_1"]) == 12 and got["title_1/chapter_III"] == got["title_1/chapter_III/section_2"]


def test_registry(spark):
    c = spark.createDataFrame([(1, "/a", "m", 1, "cfr"), (2, "/b", None, 3, "uslm")], "doc_id long, file_path string, metadata string, stage_reached int, parser_type string")
    n = spark.createDataFrame([(9, "/a", None, 2, "cfr"), (3, "/c", None, 1, "cfr")], c.schema)
    got = {r.file_path: (r.doc_id, r.metadata, r.stage_reached) for r in registry.documents_added(c, n).collect()}
    assert got == {"/a": (1, "m", 2), "/b": (2, None, 3), "/c": (3, None, 1)}
    s = "ref_id long, source_doc_id long, source_item_type string, source_item_number string, status string, target_doc_id long, target_item_type string, target_item_number string, resolution_method string, resolved_at timestamp, notes string"
    r = spark.createDataFrame([(1, 1, "section", "1", "unresolved", None, None, None, None, None, None), (2, 2, "section", "2", "resolved", 1, None, None, "manual", None, None)], s)
    x = registry.resolved(r, 1, 2, "section", "5", "manual", F.lit(dt.datetime(2026, 1, 1)))
    assert x.where("ref_id = 1").first()["target_doc_id"] == 2
    assert registry.reset(x, 1).where("ref_id = 1").first()["target_doc_id"] is None
    assert registry.marked(r, 2, "ambiguous", "n").where("ref_id = 2").first()["target_doc_id"] == 1
    assert registry.without_document(r, 1).count() == 1 and registry.selected(r, status="resolved").count() == 1
    assert registry.without_items(r, r.where("ref_id = 1").select("source_doc_id", "source_item_type", "source_item_number")).count() == 1
    assert {k.name: k.n for k in registry.stats(c, r).collect()} == {"documents": 2, "references": 2, "status unresolved": 1, "status resolved": 1}
    links = spark.createDataFrame([(1, 2, "part")], "parent_doc_id long, child_doc_id long, split_type string")
    assert registry.links_added(links, links.unionByName(links.withColumn("child_doc_id", F.lit(5).cast("long")))).count() == 2
    assert {k.parser_type: (k.n_docs, k.n_stage_2) for k in registry.by_parser(c).collect()} == {"cfr": (1, 0), "uslm": (1, 1)}


def test_extraction(spark):
    needs = spark.createDataFrame([("d", "s1", "External", "x"), ("d", "s1", "External", "x"), ("d", "s2", "Internal", "y"), ("d", "s3", "External", "z")], "doc_id string, unit_path string, ref_type string, ref_value string")
    defs = spark.createDataFrame([("d", "", "t", "12 U.S.C."), ("d", "s1", "u", None)], "doc_id string, location_path string, term string, external_reference string")
    leaves = needs.where("unit_path = 's1'").select("doc_id", "unit_path").distinct()
    assert registry.extracted(needs, defs).count() == 3 and registry.extracted(needs, defs, leaves).count() == 2


def test_data_source(spark, tmp_path):
    from lexspan.sources.datasource import UnitSource
    from tests.test_sources import USC

    (tmp_path / "a.xml").write_bytes(USC)
    spark.dataSource.register(UnitSource)
    got = spark.read.format("lexspan_units").option("kind", "uslm").load(str(tmp_path)).orderBy("ord").collect()
    assert [r.unit_id for r in got] == ["7", "8", "1"] and got[0].notes == {"1": "A note."}


def test_everything_is_registered():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) > 55 and set(o) <= set(q)

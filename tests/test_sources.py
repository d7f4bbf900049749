import json

from lexspan.sources import call_logs, markup, trees
from lexspan.streaming import job_events

USC = b"""<uslm xmlns="http://x"><title identifier="/us/usc/t1"><num value="1">Title 1</num><heading>General</heading>
<chapter><num value="2">Chapter 2</num><heading>Rules</heading>
<section><num value="7">\xc2\xa7 7. </num><heading>Marriage</heading><subsection><num>(a)</num><content>First part.</content></subsection>
<subsection><num>(b)</num><content>Second<ref class="footnoteRef">1</ref><note type="footnote"><num>1</num> A note.</note> part.</content></subsection><sourceCredit>(Oct. 3)</sourceCredit></section>
<section><num value="8">8</num><heading>Table</heading><content>See <table>%s</table></content></section></chapter></title></uslm>""" % (b"<tr><td>x</td></tr>" * 30)
CFR = b"""<ECFR><DIV1 TYPE="TITLE" N="15"><DIV5 TYPE="PART" N="7"><HEAD>PART 7</HEAD><DIV8 TYPE="SECTION" N="\xc2\xa7 7.1"><HEAD>\xc2\xa7 7.1 Scope.</HEAD><P>Text one.</P><P>(a) Text two.</P></DIV8>
<DIV9 TYPE="APPENDIX" N="Appendix A"><HEAD>Appendix A [Reserved]</HEAD></DIV9></DIV5><DIV8 TYPE="SECTION" N="\xc2\xa7 1.1"><HEAD>\xc2\xa7 1.1 Top.</HEAD><P>Top.</P></DIV8></DIV1></ECFR>"""
EU = b"""<ACT><PREAMBLE><CONSID><NP><NO.P>(1)</NO.P><TXT>Whereas.</TXT></NP></CONSID></PREAMBLE><ENACTING.TERMS><DIVISION><TITLE><TI>CHAPTER I</TI></TITLE>
<ARTICLE IDENTIFIER="003"><TI.ART>Article 3</TI.ART><STI.ART><P>Definitions</P></STI.ART><ALINEA><P>These apply:</P><LIST><ITEM><NP><NO.P>(1)</NO.P><TXT>one;</TXT></NP></ITEM></LIST></ALINEA></ARTICLE></DIVISION></ENACTING.TERMS><ANNEX><TITLE><TI>ANNEX II</TI></TITLE><P>List.</P></ANNEX></ACT>"""
CA = b"""<div id="manylawsections"><div><h4>TITLE 2. GOVERNMENT</h4></div><h6><a>11124.</a></h6><p>(a) No person.</p><p>(b) If a list.</p><p>(Amended by Stats. 2020 (Ch. 1).)</p><h6>11124.</h6><p>Again.</p></div>"""


def rows(spark, data, kind, **options):
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    return markup.units_of(files, kind, **options).orderBy("ord").collect()


def test_uslm(spark):
    a, b, t = rows(spark, USC, "uslm")
    assert (a.unit_id, a.unit_title, a.org_path) == ("7", "Marriage", "title_1/chapter_2")
    assert "First part." in a.text and "Oct. 3" not in a.text and "(note: 1)" in a.text and a.notes == {"1": "A note."}
    assert len(a.breakpoints) >= 1 and a.text[a.breakpoints[0].pos :].startswith("(b)")
    assert (t.unit_path, t.table_row_count, t.depth) == ("section_8/table_1", 30, 1) and "[Table 1 extracted as sub-unit table 1]" in b.text
    assert "section 7 appears twice" in rows(spark, USC.replace(b'value="8"', b'value="7"'), "uslm")[0].error
    assert rows(spark, b"not xml", "uslm")[0].error.startswith("ParseError")


def test_ecfr(spark):
    got = rows(spark, CFR, "ecfr")
    assert [(r.unit_type, r.unit_id, r.org_path) for r in got] == [("section", "7.1", "title_15/part_7"), ("appendix", "A", "title_15/part_7"), ("section", "1.1", "title_15")]
    assert got[0].text == "Text one.\n(a) Text two." and got[0].unit_title == "Scope." and got[1].annotation == "[Reserved]"
    assert [r.unit_id for r in rows(spark, CFR, "ecfr", residual=True)] == ["1.1"]
    assert [r.unit_id for r in rows(spark, CFR, "ecfr", specific={"part": "7"})] == ["7.1", "A"]
    files = spark.createDataFrame([("f", bytearray(CFR))], "path string, content binary")
    assert [r.org_path for r in markup.split_units(markup.units_of(files, "ecfr"), "part").collect()] == ["title_15/part_7"]


def test_formex(spark):
    got = rows(spark, EU, "formex")
    assert [(r.unit_type, r.unit_id) for r in got] == [("recital", "1"), ("article", "3"), ("annex", "II")]
    assert got[1].unit_title == "Definitions" and got[1].org_path == "chapter_I" and got[1].text.startswith("These apply:\n(1)")


def test_ca_html(spark):
    a, b = rows(spark, CA, "ca_html")
    assert (a.unit_id, b.unit_id) == ("11124", "11124_dup") and a.org_path == "title_2"
    assert a.text == "(a) No person.\n(b) If a list." and a.annotation == "Amended by Stats. 2020 (Ch. 1)." and [tuple(p) for p in a.breakpoints] == [(15, 1)]


def test_trailing_paren():
    assert markup.trailing_paren("Text here. (Amended by Stats. 2020 (Ch. 1).)") == ("Text here. ", "Amended by Stats. 2020 (Ch. 1).")
    assert markup.trailing_paren("") == ("", "") and markup.trailing_paren("a)") == ("a)", "")


def test_tables_as_text():
    html = "<table><tr><th>A</th><th colspan=2>B</th></tr><tr><td rowspan=2>x</td><td>1<td>2</tr><tr><td>3</td><td>4</td></tr></table>"
    assert markup.table_grid(html) == [["A", "B", ""], ["x", "1", "2"], ["", "3", "4"]]
    assert markup.table_text(html).splitlines()[1].split() == ["x", "|", "1", "|", "2"]
    nested = "<table><tr><td><table></table></td></tr></table>"
    assert markup.table_text(nested) == nested and markup.table_grid("<table><tr><td colspan=21></td></tr></table>") is None


TREE = {
    "document_information": {
        "title": "T", "parameters": {"1": {"name": "section", "name_plural": "sections", "operational": 1}, "2": {"name": "table", "name_plural": "tables", "is_sub_unit": True, "data_table": 1}},
        "organization": {"content": {"title": {"1": {"unit_title": "G", "begin_section": "1", "chapter": {"2": {"unit_title": "R", "unit_definitions": [{"term": "x", "value": "y"}]}}}}}},
        "document_definitions": [{"term": "d", "value": "e"}], "content_scope": [{"title": "1"}],
    },
    "content": {"sections": {"1": {"text": "a", "breakpoints": [[3, 1]], "notes": {"1": "n"}, "context": [{"title": "1"}, {"name": "chapter", "number": 2}], "need_ref": [{"type": "External", "value": "12 U.S.C."}], "sub_units": {"2": {"1": {"table_html": "<table>"}}}}}},
}


def test_trees(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TREE))
    (tmp_path / "b.json").write_text("[1]")
    t = trees.tables(trees.read(spark, str(tmp_path)))
    assert [(r.org_path, r.unit_title, r.depth) for r in t["orgs"].orderBy("ord").collect()] == [("title_1", "G", 0), ("title_1/chapter_2", "R", 1)]
    u = t["units"].orderBy("ord").collect()
    assert [(r.unit_path, r.org_path) for r in u] == [("section_1", "title_1/chapter_2"), ("section_1/table_1", "")]
    assert tuple(u[0].breakpoints[0]) == (3, 1) and u[0].notes[0].text == "n"
    assert sorted((r.location_kind, r.term) for r in t["definitions"].collect()) == [("document", "d"), ("org", "x")]
    assert t["need_refs"].first()["ref_value"] == "12 U.S.C." and t["unit_types"].count() == 2
    assert [tuple(x) for x in t["documents"].first()["content_scope"]] == [("title", "1")]


def test_manifests(spark, tmp_path):
    (tmp_path / "x_manifest.json").write_text(json.dumps({"source_type": "cfr", "parsed_files": [{"file": "a", "type": "part", "organizational_units": {"part": "7"}}, {"file": "b", "type": "part", "organizational_units": {}}]}))
    m = trees.manifests(spark, str(tmp_path))
    assert [(r.file, r.parser_type) for r in trees.filtered(m, {"part": "7"}).collect()] == [("a", "cfr")] and m.count() == 2


def test_call_logs(spark):
    log = b'["t", "c", "p", "r", 1, 2, "CACHED"] x ["t2", null, "a [ b", {"k": 1}] [["a","b","c"]] ["cut'
    files = spark.createDataFrame([("f", bytearray(log))], "path string, content binary")
    got = call_logs.calls_of(files).orderBy("seq").collect()
    assert [(r.ts, r.prompt, r.cached) for r in got] == [("t", "p", True), ("t2", "a [ b", False), (None, "b", False)]
    assert call_logs.calls_of(files, strict=True).count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, "queued", "parse", "2026-01-01 00:00:01"), (2, "running", "parse", "2026-01-01 00:00:02"), (3, "queued", "stage_2", "2026-01-01 00:00:00")]
    spark.createDataFrame(rows, "job_id long, status string, job_type string, ts string").selectExpr("job_id", "status", "job_type", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    seen = []
    q = job_events.run_worker(job_events.read(spark, str(tmp_path / "in")), {"parse": lambda d: seen.extend(r.job_id for r in d.collect())}, str(tmp_path / "c1"))
    assert q.awaitTermination(60) and seen == [1]
    progress = job_events.read(spark, str(tmp_path / "in")).selectExpr("job_type as job_id", "status as items_done", "ts")
    assert job_events.flush(job_events.changes(progress), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert job_events.counts_by_window(job_events.read(spark, str(tmp_path / "in"))).isStreaming

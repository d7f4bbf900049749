from pyspark.sql import functions as F

from lexspan.operators import outline, references

CCL = """intro
##HD1## Category 3
##HD1## A. Equipment
notes on A
**3A001 Electronics**
a. item
**3A002 More**
b. item
**3A001 Again**
##HD1## Category 5
**5B001 Test**
t"""


def test_commerce_list(spark):
    d = spark.createDataFrame([(1, CCL)], "id int, text string")
    got = [(r.category, r.section, r.entry, r.body.split("\n")[0]) for r in outline.commerce_list(d, ["id"], "text").orderBy("pos").collect()]
    assert got == [(None, "default", "_preamble", "intro"), ("3", "A", "_preamble", "notes on A"), ("3", "A", "3A001", "**3A001 Electronics**"), ("3", "A", "3A002", "**3A002 More**"), ("3", "A", "3A001_2", "**3A001 Again**"), ("5", "default", "5B001", "**5B001 Test**")]


def test_method_sections(spark):
    d = spark.createDataFrame([(1, "x\n##HD1## Method 1—A\none\n##HD1## Method 2—B\ntwo\nmore"), (2, "##HD1## Method 1\none"), (3, "##HD1## Method 1\n##HD1## Method 2\ntwo")], "id int, text string")
    assert sorted((r.id, r.section, r.body) for r in outline.method_sections(d, ["id"], "text").collect()) == [(1, "Method 1", "one"), (1, "Method 2", "two\nmore")]


def test_definition_lists(spark):
    rows = [(1, i, f'(a) "term {i}" means ' + "x" * 1500, True) for i in range(5)] + [(2, i, "y" * 2000, True) for i in range(4)] + [(3, i, "plain " * 400, True) for i in range(5)] + [(4, i, "z" * 2000, False) for i in range(6)]
    d = spark.createDataFrame(rows, "id int, ord int, text string, chapeau boolean")
    assert sorted((r.id, r.quoted_share) for r in outline.definition_lists(d, ["id"]).collect()) == [(1, 1.0), (3, 0.0)]


def test_terms(spark):
    n = spark.createDataFrame([(1, '**"AI system"**'), (1, "AI systems"), (1, "providers"), (1, "unheard of")], "d int, term string")
    k = spark.createDataFrame([(1, "ai system"), (1, "Provider"), (2, "unheard of")], "d int, term string")
    got = {r.term: r.matched for r in outline.matched_terms(n, k, ["d"]).collect()}
    assert got == {'**"AI system"**': "ai system", "AI systems": "ai system", "providers": "provider", "unheard of": None}


def test_matched_terms_takes_every_part(spark, tmp_path):
    import random
    from difflib import SequenceMatcher

    from lexspan.plans.outline_queries import matched_terms

    r = random.Random(5)
    parts = [(k, f"Brand#{k % 3}", " ".join(r.choice(["almond", "blue", "coral", "blush", "Élan"]) for _ in range(4))) for k in range(1, 640, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    known = {b: sorted({n.lower() for _, c, n in parts if c == b}) for _, b, _ in parts}

    def match(brand, k):
        if k in known[brand]:
            return k
        for t in (k, k[:-1] if k.endswith("s") else ""):
            best = min(((-x, h) for h in known[brand] if (x := SequenceMatcher(None, t, h).ratio()) > 0.87), default=None)
            if best:
                return best[1]

    want = {(b, f'"{n}' + "s" * (k % 2 == 0) + '"'): match(b, n.lower() + "s" * (k % 2 == 0)) for k, b, n in parts}
    assert {(x.p_brand, x.term): x.matched for x in matched_terms(spark, str(tmp_path)).collect()} == want


def test_names(spark):
    d = spark.createDataFrame([("Supplement No. 1 to Part 714",), ("SFAR No. 36",), ("Appendix A to Part 17",), ("B",)], "n string")
    got = [tuple(r[0]) for r in d.select(outline.appendix_kind(F.col("n"))).collect()]
    assert got == [("supplements", "No. 1 to Part 714"), ("special federal aviation regulations", "No. 36"), ("appendices", "A to Part 17"), ("appendices", "B")]
    m = spark.createDataFrame([({"part": "7", "title": "1"},), ({"x": "1"},)], "m map<string,string>")
    assert [r[0] for r in m.select(outline.unit_suffix(F.col("m"))).collect()] == ["_title1_part7", ""]
    assert [r[0] for r in spark.createDataFrame([(" —Scope. ",)], "t string").select(outline.clean_title(F.col("t"))).collect()] == ["Scope"]
    p = spark.createDataFrame([("/a/L_1.doc.xml",), ("/a/L_2.doc.fmx.xml",), ("/a/x_processed.json",)], "p string")
    assert [r[0] for r in p.select(references.stem(F.col("p"))).collect()] == ["L_1", "L_2", "x"]


def test_siblings(spark):
    u = spark.createDataFrame([("d", "a", "c_1"), ("d", "b", "c_1"), ("d", "e", "c_2")], "doc_id string, unit_path string, org_path string")
    p = spark.createDataFrame([("d", "a", "b"), ("d", "a", "e")], "doc_id string, path_a string, path_b string")
    assert [(r.path_a, r.path_b) for r in outline.siblings(p, u).collect()] == [("a", "b")]

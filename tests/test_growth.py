"""What must not grow faster than its input, and results that hold for large keys."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexspan.functions import text
from lexspan.operators import chunking, definitions, markup_scan, scopes, tree


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_range_sizes_count_what_ranges_finds(spark):
    units = spark.createDataFrame([("d", "s", str(i), i) for i in range(10)] + [("d", "s", "3", 10)], "doc_id string, type_key string, unit_id string, ord long")
    wanted = spark.createDataFrame([(1, "d", "s", "2", "5"), (2, "d", "s", "5", "2"), (3, "d", "s", "4", "4"), (4, "d", "s", "8", "3"), (5, "d", "s", "1", "x"), (6, "e", "s", "1", "2")], "range_id long, doc_id string, type_key string, first_id string, last_id string")
    for parity in (False, True):
        want = {(r.range_id, r.n) for r in tree.ranges(units, wanted, parity).groupBy("range_id").agg(F.count("*").alias("n")).collect()}
        assert {tuple(r) for r in tree.range_sizes(units, wanted, parity).collect()} == want
    assert want == {(1, 4), (2, 7), (3, 7), (4, 4)}


def test_open_ranges_are_counted_without_a_row_for_each_unit(spark):
    assert "Generate" not in plan(__spark_entry__.queries()["range_expand_parity"](spark, "/root/testdata/sf0.001"))


def test_a_place_with_many_definitions_meets_what_is_wanted_once(spark):
    n = 20_000  # 400 million pairs
    d = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("p").alias("location_path"), F.lit("The Term").alias("term"), F.col("id").alias("def_id"), F.concat(F.lit("v"), "id").alias("value"))
    w = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("d").alias("doc_id"), F.lit("p").alias("location_path"), F.lit("term").alias("term"))
    met = scopes.definitions_at(w, d)
    assert met.agg(F.count("*"), F.min("value"), F.max("value")).first() == (n, "v0", "v0")
    p = met._jdf.queryExecution().optimizedPlan().toString()
    assert p.index("Join") < p.rindex("Aggregate")  # the definitions are grouped below the join


@pytest.mark.parametrize("query", ["citation_parse", "citation_resolution", "incremental_resolution"])
def test_citations_of_keys_with_many_digits_equal_their_sql(spark, tmp_path, query):
    duckdb = pytest.importorskip("duckdb")
    key = lambda n, top: (F.xxhash64("id", F.lit(n)) % top + top) % top
    line = spark.range(4000).select((F.col("id") * 7).alias("l_orderkey"), key(1, 1_500_000).alias("l_partkey"), (key(2, 50) * 1003).alias("l_suppkey"), (F.col("id") % 8).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = __spark_entry__.queries()[query](spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[query]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_capitals_come_back_in_lower_case(spark, tmp_path):
    words = ["ein Maß, ßß", "ß", "ŉ ﬁn", "", None, "abc", "a\nß b"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in rows.select(text.upper(F.col("w")), F.lower(text.upper(F.col("w")))).collect()]
    assert got == [(w and "".join(c.upper() if len(c.upper()) == 1 else c for c in w), w and w.lower()) for w in words]
    turns = [(1, 0, "Große Maße, ßß?"), (1, 1, "x"), (1, 2, "other")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same = __spark_entry__.queries()["near_duplicate_primary"](spark, str(tmp_path))
    assert {r.turn: r.same for r in same.collect()} == {0: True, 1: True, 2: False}


def test_conflicting_pairs_are_told_by_classes(spark):
    rows = [(0, "p", "The Term", "a", None), (1, "p", "term", " a ", "direct"), (2, "p", "term", "b", None), (3, "p", "term", None, None), (4, "p", "term", "c", "elaboration"), (5, "q", "term", "a", None), (6, "p", "the", "x", None)]
    rows += [(10 + i, "r", "t", f"v{i % 3}", None) for i in range(12)]
    d = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, def_id long, location_path string, term string, value string, def_kind string")
    got = definitions.conflict_classes(d)
    c = {r.def_id: r for r in got.collect()}
    assert {k: (r.class_id, r.n_links) for k, r in c.items() if k < 10} == {0: (0, 1), 1: (0, 1), 2: (2, 2), 3: (None, 0), 5: (5, 0), 6: (6, 0)}
    where = {r[0]: (r[1], r[2].lower().removeprefix("the ")) for r in rows}
    value = {r[0]: r[3] and r[3].strip() for r in rows}
    want = {(a, b) for a in c for b in c if a < b and where[a] == where[b] and value[a] is not None and value[b] is not None and value[a] != value[b]}
    told = {(a, b) for a in c for b in c if a < b and c[a][:3] == c[b][:3] and None not in (c[a].class_id, c[b].class_id) and c[a].class_id != c[b].class_id}
    assert told == want and sum(r.n_links for r in c.values()) == 2 * len(want)


def test_sections_are_gaps_without_a_copy_of_the_text_for_each_mark(spark):
    texts = ["a<p>b<p>ü😀<p>", "<p>x", "none", "", None, "<p><p>", "é<p>"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    marks = markup_scan.positions(d, ["id"], "t", "<p>").join(d, "id")
    want = sorted(map(tuple, chunking.gaps(marks, ["id"], F.col("t")).select("id", "pos", "name", "slice").collect()))
    got = chunking.sections(d, ["id"], F.col("t"), "<p>")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 9
    p = plan(__spark_entry__.queries()["element_sections"](spark, "/root/testdata/sf0.001"))
    assert not any(x in p for x in ("Join", "Window", "Aggregate"))


def test_chunks_come_out_while_a_batch_is_read(spark):
    class Units:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    texts = ["word " * 400, None, ""] * 1000 + ["x" * 3_000_000, "ü y"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts), pa.array([[]] * len(texts), pa.list_(pa.struct([("pos", pa.int32()), ("prio", pa.int32())])))], names=["key", "text", "breakpoints"])
    got = list(chunking.chunks(Units(), F.col("key"), F.col("text"), F.array(), 1500)(iter([batch])))
    assert len(got) > 4 and max(sum(map(len, b.column(4).to_pylist())) for b in got) <= 3_000_000
    told: dict[str, str] = {}
    for b in got:
        for k, c in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
            told[k] = told.get(k, "") + c
    assert told == {str(i): t for i, t in enumerate(texts) if t}


def test_terms_that_the_child_leaves_open_take_no_sort_of_all_needs(spark):
    needs = spark.createDataFrame([(1, "*A*"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (None, "a"), (3, None)], "doc_id long, ref_value string")
    own = spark.createDataFrame([(1, "B"), (2, '"A"'), (None, "a"), (4, "a")], "doc_id long, term string")
    parent = spark.createDataFrame([(0, '"a"', "va"), (0, "b", "vb"), (0, None, "n")], "doc_id long, term string, value string")
    got = definitions.from_parent(needs, own, parent)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, '"a"', "va"), (None, '"a"', "va")]))
    p = plan(got)
    assert "LeftAnti" not in p and p.count("Aggregate") == 1

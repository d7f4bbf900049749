"""Files of each markup format, made of the driver's tables, as unit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.rollup import top_summaries
from lexspan.plans._tables import table
from lexspan.sources import markup, trees

_S = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _joined(rows: DataFrame, by: list[str], order: str, piece: Column, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("p")))), lambda x: x["p"]), "").alias(name))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))


def _files(rows: DataFrame, region: str, markup_: Column) -> DataFrame:
    return rows.select(F.col(region).cast("string").alias("path"), markup_.cast("binary").alias("content"))


def uslm_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region: nations are chapters, suppliers sections with a
    subsection and a footnote; every fifth holds a section of its own."""
    s = _suppliers(spark, sf_dir)
    k = F.col("s_suppkey")
    quoted = F.when(k % 5 == 0, _S("<quotedContent><section><num value='q", k, "'/><heading>Quoted</heading><content>inner words</content></section></quotedContent>")).otherwise("")
    section = _S("<section><num value='", k, "'>§ ", k, ".</num><heading>", F.col("s_name"), "</heading><chapeau>Opening</chapeau><subsection><num>(a)</num><content>of nation ", F.col("s_nationkey"), "</content></subsection>", quoted, "</section>")
    chapters = _joined(s, ["n_regionkey", "n_nationkey", "n_name"], "s_suppkey", section, "body")
    chapter = _S("<chapter><num value='", F.col("n_nationkey"), "'/><heading>", F.col("n_name"), "</heading>", F.col("body"), "</chapter>")
    titles = _joined(chapters, ["n_regionkey"], "n_nationkey", chapter, "body")
    got = markup.units_of(_files(titles, "n_regionkey", _S("<uslm xmlns='urn:x'><main><title><num value='", F.col("n_regionkey"), "'/>", F.col("body"), "</title></main></uslm>")), "uslm")
    return got.select("path", "unit_id", "unit_path", "org_path", "depth", "unit_title", F.regexp_replace("text", r"\s+", " ").alias("text"))


def uslm_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the sections of chapter 8."""
    s = _suppliers(spark, sf_dir)
    chapters = _joined(s, ["n_nationkey"], "s_suppkey", _S("<section><num value='", F.col("s_suppkey"), "'/></section>"), "body")
    file = _joined(chapters.withColumn("one", F.lit(1)), ["one"], "n_nationkey", _S("<chapter><num value='", F.col("n_nationkey"), "'/>", F.col("body"), "</chapter>"), "body")
    return markup.units_of(_files(file, "one", _S("<main>", F.col("body"), "</main>")), "uslm", specific={"chapter": "8"}).select("unit_id", "org_path")


def ecfr_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part for each nation: sections of its suppliers, with appendices of
    several kinds; those of one name are settled."""
    s = _suppliers(spark, sf_dir)
    k = F.col("s_suppkey")
    section = _S("<DIV8 TYPE='SECTION' N='§ ", F.col("n_nationkey"), ".", k, "'><HEAD>§ ", F.col("n_nationkey"), ".", k, " ", F.col("s_name"), "</HEAD><P>First.</P><P>Second ", k, ".</P></DIV8>")
    app = lambda name, *body: _S("<DIV9 TYPE='APPENDIX' N='", name, "'><HEAD>Head</HEAD>", *body, "</DIV9>")
    parts = _joined(s, ["n_regionkey", "n_nationkey"], "s_suppkey", section, "body")
    n = F.col("n_nationkey")
    supplement, appendix = _S("Supplement No. ", n), _S("Appendix A", n)
    extra = _S(app(supplement), app(supplement, "<P>text</P>"), app(supplement, "<P>more</P>"), app(appendix, "<P>a</P>"), app(appendix), app(_S("SFAR ", n), "<P>r</P>"))
    part = _S("<DIV5 TYPE='PART' N='", F.col("n_nationkey"), "'><HEAD>PART</HEAD>", F.col("body"), extra, "</DIV5>")
    titles = _joined(parts, ["n_regionkey"], "n_nationkey", part, "body")
    got = markup.units_of(_files(titles, "n_regionkey", _S("<DIV1 TYPE='TITLE' N='", F.col("n_regionkey"), "'>", F.col("body"), "</DIV1>")), "ecfr")
    return got.select("path", "unit_type", "unit_id", "org_path", "unit_title", F.regexp_replace("text", r"\s+", " ").alias("text"))


def formex_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An act for each region: a recital for each nation, their suppliers' articles in chapters, and an annex."""
    s = _suppliers(spark, sf_dir)
    article = _S("<ARTICLE><TI.ART>Article ", F.col("s_suppkey"), "</TI.ART><STI.ART>", F.col("s_name"), "</STI.ART><ALINEA>Words ", F.col("s_suppkey"), "</ALINEA></ARTICLE>")
    chapters = _joined(s, ["n_regionkey", "n_nationkey", "n_name"], "s_suppkey", article, "body")
    recital = _S("<CONSID><NP><NO.P>(", F.col("n_nationkey"), ")</NO.P><TXT>Whereas ", F.col("n_name"), "</TXT></NP></CONSID>")
    division = _S("<DIVISION><TITLE><TI>CHAPTER ", F.col("n_nationkey"), "</TI></TITLE>", F.col("body"), "</DIVISION>")
    acts = _joined(chapters, ["n_regionkey"], "n_nationkey", division, "body").join(_joined(chapters, ["n_regionkey"], "n_nationkey", recital, "head"), "n_regionkey")
    file = _S("<ACT><PREAMBLE>", F.col("head"), "</PREAMBLE>", F.col("body"), "<ANNEX><TITLE><TI>ANNEX I</TI></TITLE><P>list</P></ANNEX></ACT>")
    got = markup.units_of(_files(acts, "n_regionkey", file), "formex")
    return got.select("path", "unit_type", "unit_id", "org_path", "unit_title", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))


def ca_html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: sections with a history note."""
    s = _suppliers(spark, sf_dir)
    section = _S("<h6>", F.col("s_suppkey"), ".</h6><p>(a) Text of ", F.col("s_name"), ".</p><p>(b) End. (Added by Stats. ", F.col("s_suppkey") % 9, ".)</p>")
    pages = _joined(s, ["n_nationkey"], "s_suppkey", section, "body")
    got = markup.units_of(_files(pages, "n_nationkey", _S("<html><body><h3>CHAPTER ", F.col("n_nationkey"), ". Name</h3>", F.col("body"), "</body></html>")), "ca_html")
    return got.select("path", "unit_id", "org_path", F.regexp_replace("text", r"\s+", " ").alias("text"), "annotation")


def files_that_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file isn't well formed: one row with the error's kind."""
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 3 == 0, _S("<main><section>")).otherwise(_S("<main><section><num value='1'/></section></main>"))
    got = markup.units_of(_files(n, "n_nationkey", body), "uslm")
    return got.select("path", "unit_id", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


def split_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations that a region's suppliers are split by."""
    s = _suppliers(spark, sf_dir)
    u = s.select(F.col("n_regionkey").cast("string").alias("path"), _S("region_", F.col("n_regionkey"), "/nation_", F.col("n_nationkey"), "/supplier_", F.col("s_suppkey")).alias("org_path"))
    return markup.split_units(u, "nation")


def parsed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each region, its nations units and suppliers sub-units, taken apart again; counted by kind of row and depth."""
    s = _suppliers(spark, sf_dir)
    sub = _S('"', F.col("s_suppkey"), '": {"text": "', F.col("s_name"), '", "defined_terms": [{"term": "t', F.col("s_suppkey"), '", "value": "v"}], "need_ref": [{"type": "External", "value": "x"}]}')
    inner = s.groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.array_join(F.sort_array(F.collect_list(sub)), ", ").alias("subs"))
    unit = _S('"', F.col("n_nationkey"), '": {"unit_title": "', F.col("n_name"), '", "context": [{"region": "', F.col("n_regionkey"), '"}], "sub_units": {"2": {', F.col("subs"), "}}}")
    docs = inner.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(unit)), ", ").alias("units"))
    file = _S('{"document_information": {"title": "R", "parameters": {"1": {"name": "nation", "name_plural": "nations", "operational": 1}, "2": {"name": "supplier", "name_plural": "suppliers", "is_sub_unit": true}}, "organization": {"content": {"region": {"', F.col("n_regionkey"), '": {"unit_title": "r"}}}}, "document_definitions": [{"term": "d", "value": "w"}]}, "content": {"nations": {', F.col("units"), "}}}")
    rows = trees.rows_of(_files(docs, "n_regionkey", file))
    return rows.groupBy("doc", "kind", F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count("*").alias("n_rows"), F.min("path").alias("least_path"))


def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of one title and part."""
    p = table(spark, sf_dir, "part")
    levels = F.create_map(F.lit("title"), (F.col("p_size") % 10).cast("string"), F.lit("part"), (F.col("p_partkey") % 7).cast("string"))
    return trees.filtered(p.select(F.col("p_partkey").alias("file"), levels.alias("organizational_units")), {"title": "3", "part": "2"}).select("file")


def top_level_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of regions, one text for each document (here the key's parity)."""
    r = table(spark, sf_dir, "region")
    o = r.select((F.col("r_regionkey") % 2).alias("doc_id"), F.lit(0).alias("depth"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("summary_1"), F.when(F.col("r_regionkey") == 3, F.lit("second")).alias("summary_2"))
    return top_summaries(o)


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column tables of suppliers as padded text."""
    s = _suppliers(spark, sf_dir)
    html = _joined(s, ["n_nationkey"], "s_suppkey", _S("<tr><td>", F.col("s_suppkey"), "</td><td>", F.col("s_name"), "</td></tr>"), "rows")

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markup.table_text(x) for x in b.column(1).to_pylist()])], names=["n_nationkey", "text"])

    return html.select("n_nationkey", _S("<table>", F.col("rows"), "</table>").alias("html")).mapInArrow(run, "n_nationkey int, text string")


_S_SQL = "s AS (SELECT s_suppkey AS k, s_name, n_nationkey AS n, n_name, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"

QUERIES = {
    "uslm_units": uslm_units, "uslm_chapter": uslm_chapter, "ecfr_units": ecfr_units, "formex_units": formex_units, "ca_html_units": ca_html_units, "files_that_fail": files_that_fail, "split_levels": split_levels,
    "parsed_trees": parsed_trees, "manifest_filter": manifest_filter, "top_level_summaries": top_level_summaries, "table_texts": table_texts,
}
ORACLES = {
    "uslm_units": f"WITH {_S_SQL} SELECT r::VARCHAR AS path, k::VARCHAR AS unit_id, 'section_' || k AS unit_path, 'title_' || r || '/chapter_' || n AS org_path, 0 AS depth, s_name AS unit_title, 'Opening (a)of nation ' || n || CASE WHEN k % 5 = 0 THEN ' inner words' ELSE '' END AS text FROM s UNION ALL SELECT r::VARCHAR, 'q' || k, 'section_' || k || '/section_q' || k, 'title_' || r || '/chapter_' || n, 1, 'Quoted', 'inner words' FROM s WHERE k % 5 = 0",
    "uslm_chapter": f"WITH {_S_SQL} SELECT k::VARCHAR AS unit_id, 'chapter_8' AS org_path FROM s WHERE n = 8",
    "ecfr_units": f"WITH {_S_SQL}, p AS (SELECT DISTINCT r, n FROM s) SELECT r::VARCHAR AS path, 'section' AS unit_type, n || '.' || k AS unit_id, 'title_' || r || '/part_' || n AS org_path, s_name AS unit_title, 'First. Second ' || k || '.' AS text FROM s UNION ALL SELECT r::VARCHAR, t, i || n || j, 'title_' || r || '/part_' || n, 'Head', x FROM p, (VALUES ('supplement', 'No. ', '', 'text'), ('supplement', 'No. ', '_dup', 'more'), ('appendix', 'A', '', 'a'), ('special federal aviation regulation', '', '', 'r')) v(t, i, j, x)",
    "formex_units": f"WITH {_S_SQL}, p AS (SELECT DISTINCT r, n, n_name FROM s) SELECT r::VARCHAR AS path, 'article' AS unit_type, k::VARCHAR AS unit_id, 'chapter_' || n AS org_path, s_name AS unit_title, 'Words ' || k AS text FROM s UNION ALL SELECT r::VARCHAR, 'recital', n::VARCHAR, '', '', 'Whereas ' || n_name FROM p UNION ALL SELECT DISTINCT r::VARCHAR, 'annex', 'I', '', 'ANNEX I', 'ANNEX I list' FROM p",
    "ca_html_units": f"WITH {_S_SQL} SELECT n::VARCHAR AS path, k::VARCHAR AS unit_id, 'chapter_' || n AS org_path, '(a) Text of ' || s_name || '. (b) End.' AS text, 'Added by Stats. ' || k % 9 || '.' AS annotation FROM s",
    "files_that_fail": "SELECT n_nationkey::VARCHAR AS path, CASE WHEN n_nationkey % 3 <> 0 THEN '1' END AS unit_id, CASE WHEN n_nationkey % 3 = 0 THEN 'ParseError' END AS error FROM nation",
    "split_levels": f"WITH {_S_SQL} SELECT DISTINCT r::VARCHAR AS path, 'region_' || r || '/nation_' || n AS org_path FROM s",
    "parsed_trees": f"""WITH {_S_SQL}, x AS (
SELECT r, 'document' AS kind, -1 AS depth, '' AS path FROM (SELECT DISTINCT r FROM s) UNION ALL SELECT r, 'unit_type', -1, NULL FROM (SELECT DISTINCT r FROM s), range(2) UNION ALL SELECT r, 'definition', -1, '' FROM (SELECT DISTINCT r FROM s)
UNION ALL SELECT r, 'org', 0, 'region_' || r FROM (SELECT DISTINCT r FROM s) UNION ALL SELECT r, 'unit', 0, 'nation_' || n FROM (SELECT DISTINCT r, n FROM s)
UNION ALL SELECT r, kind, CASE kind WHEN 'unit' THEN 1 ELSE -1 END, 'nation_' || n || '/supplier_' || k FROM s, (VALUES ('unit'), ('definition'), ('need_ref')) v(kind))
SELECT r::VARCHAR AS doc, kind, depth, count(*) AS n_rows, min(path) AS least_path FROM x GROUP BY ALL""",
    "manifest_filter": "SELECT p_partkey AS file FROM part WHERE p_size % 10 = 3 AND p_partkey % 7 = 2",
    "top_level_summaries": "SELECT r_regionkey % 2 AS doc_id, string_agg(CASE WHEN r_regionkey = 3 THEN 'second' ELSE r_name END, chr(10) || chr(10) ORDER BY r_regionkey) AS summary FROM region GROUP BY 1",
    "table_texts": f"WITH {_S_SQL}, w AS (SELECT *, greatest(5, max(len(k::VARCHAR)) OVER (PARTITION BY n)) AS a FROM s) SELECT n AS n_nationkey, string_agg(rpad(k::VARCHAR, a::INT, ' ') || ' | ' || s_name, chr(10) ORDER BY k) AS text FROM w GROUP BY n",
}

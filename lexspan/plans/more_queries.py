"""Unit rules, scopes, registry rewrites and scratch lists over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import analysis, logs, ranking, references, registry, scopes, tree, units
from lexspan.plans._tables import GEOGRAPHY_SQL, geography, table


def duplicates_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand by size: every third has no text."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("string").alias("unit_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("text"))
    return units.duplicates_settled(p, ["p_brand"]).select("p_brand", "unit_id", "ord")


def metadata_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers; every fourth has a twin by _dup."""
    s = table(spark, sf_dir, "supplier")
    note = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.struct(F.lit("1").alias("id"), F.col("s_name").alias("text")))).otherwise(F.array().cast("array<struct<id:string,text:string>>"))
    base = s.select(F.lit(0).alias("doc_id"), F.lit("s").alias("type_key"), F.col("s_suppkey").cast("string").alias("unit_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("annotation"), note.alias("notes"))
    twin = base.where(F.col("unit_id").cast("long") % 4 == 0).withColumn("unit_id", F.concat("unit_id", F.lit("_dup")))
    return units.metadata_suffix(base.unionByName(twin)).select("unit_id", "suffix")


_SUFFIX_SQL = """WITH b AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS unit_id, CASE WHEN s_suppkey % 2 = 0 THEN '[ANNOTATION]: ' || s_name END AS a, CASE WHEN s_suppkey % 3 = 0 THEN '[NOTES]: Note 1: ' || s_name END AS n FROM supplier)
SELECT unit_id, CASE WHEN k % 4 = 0 AND coalesce(a, n) IS NOT NULL THEN chr(10) || chr(10) || concat_ws(chr(10) || chr(10), a, n) ELSE '' END AS suffix FROM b UNION ALL SELECT unit_id || '_dup', chr(10) || chr(10) || concat_ws(chr(10) || chr(10), a, n) FROM b WHERE k % 4 = 0"""


def targets_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of orders, at most 15, from the first priority if it has both ends."""
    o = table(spark, sf_dir, "orders")
    u = o.select(F.col("o_orderpriority").alias("doc_id"), F.lit("o").alias("type_key"), (F.col("o_orderkey") % 500).cast("string").alias("unit_id"), F.col("o_orderkey").alias("ord")).where("ord < 2000")
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref_id"), F.lit("o").alias("type_key"), (F.col("n_nationkey") * 9).cast("string").alias("first_id"), (F.col("n_nationkey") * 9 + 40).cast("string").alias("last_id"))
    return analysis.targets(w, u, "2-HIGH").select("ref_id", "doc_id", "unit_id", "ord")


_TARGETS_SQL = """WITH u AS (SELECT o_orderpriority AS d, (o_orderkey % 500)::VARCHAR AS i, o_orderkey AS k FROM orders WHERE o_orderkey < 2000), f AS (SELECT d, i, min(k) AS k FROM u GROUP BY 1, 2),
e AS (SELECT n_nationkey AS ref_id, a.d, a.k AS a, b.k AS b, row_number() OVER (PARTITION BY n_nationkey ORDER BY a.d <> '2-HIGH', a.d) AS r FROM nation JOIN f a ON a.i = (n_nationkey * 9)::VARCHAR JOIN f b ON b.d = a.d AND b.i = (n_nationkey * 9 + 40)::VARCHAR)
SELECT ref_id, doc_id, unit_id, ord FROM (SELECT ref_id, u.d AS doc_id, u.i AS unit_id, u.k AS ord, row_number() OVER (PARTITION BY ref_id ORDER BY u.k) AS n FROM e JOIN u ON u.d = e.d AND u.k BETWEEN least(a, b) AND greatest(a, b) WHERE r = 1) WHERE n <= 15"""


def _orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography(spark, sf_dir).select("doc_id", F.col("unit_path").alias("org_path"), F.col("parent_unit_path").alias("parent_path"), F.col("type_key").alias("level_type"), F.col("unit_id").alias("level_id"), "depth", "ord")


def scored_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations of even key score 0: suppliers below two zeros are left out."""
    o = _orgs(spark, sf_dir)
    own = o.where("depth < 2").select("doc_id", "org_path", (F.col("level_id").cast("int") % 2).alias("score"))
    return analysis.scored_levels(o, own, prune="two_zero").select("org_path", "score")


def levels_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document covers nation 8 of its region: what lies off its branch isn't scored."""
    o = _orgs(spark, sf_dir)
    own = o.select("doc_id", "org_path", (F.col("level_id").cast("int") % 4).alias("score"))
    return analysis.scored_levels(o, own, scope="region_2/nation_8").select("org_path", "score")


_SCOPE_SQL = f"WITH {GEOGRAPHY_SQL} SELECT unit_path AS org_path, CASE depth WHEN 0 THEN CASE WHEN unit_id = '2' THEN 1 ELSE 0 END ELSE unit_id::INT % 4 END::INT AS score FROM geography WHERE depth = 0 OR unit_path = 'region_2/nation_8' OR starts_with(unit_path, 'region_2/nation_8/')"


def compound_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, supplier) from each supplier's place: the supplier is found below its region, wherever."""
    s = geography(spark, sf_dir).where("depth = 2")
    step = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("id"))
    region = F.regexp_extract("unit_path", r"^region_(\d+)", 1)
    w = s.select(F.col("unit_id").alias("ref_id"), "doc_id", F.col("parent_unit_path").alias("org_path"), F.array(step("region", region), step("supplier", F.when(F.col("ord") % 4 == 0, "none").otherwise(F.col("unit_id")))).alias("elements"))
    return scopes.compound(w, _orgs(spark, sf_dir))


def indirect_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose definition is that of the part before."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = p.select(F.lit(0).alias("doc_id"), k.alias("def_id"), k.cast("string").alias("location_path"), F.lit("unit").alias("location_kind"), F.concat(F.when(k % 2 == 0, "The ").otherwise(""), F.lit("Term")).alias("term"), F.when(k % 4 != 0, F.col("p_name")).alias("value"), F.when(k % 12 == 0, k).when(k % 4 == 0, k - 1).cast("string").alias("indirect_loc_path"))
    return scopes.indirect(d).select("def_id", "value", "location_kind")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' documents meet a new batch: even ones come again without metadata, and ten are new."""
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("file_path"), F.col("n_name").alias("metadata"), F.lit(1).alias("stage_reached"))
    new = n.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 100).cast("long").alias("doc_id"), F.col("n_name").alias("file_path"), F.lit(None).cast("string").alias("metadata"), F.lit(2).alias("stage_reached")).unionByName(n.where("n_nationkey < 10").select((F.col("n_nationkey") + 200).cast("long").alias("doc_id"), F.concat("n_name", F.lit("!")).alias("file_path"), F.lit("m").alias("metadata"), F.lit(3).alias("stage_reached")))
    return registry.documents_added(old, new)


def registry_add_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as references; those of definitions are told apart by term."""
    li = table(spark, sf_dir, "lineitem")
    ident = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey")
    r = li.select(ident.alias("ref_id"), (F.col("l_suppkey") % 10).alias("source_doc_id"), F.lit("section").alias("source_item_type"), (F.col("l_partkey") % 20).cast("string").alias("source_item_number"), (F.col("l_orderkey") % 7).cast("string").alias("ref_text"), F.when(F.col("l_linenumber") % 2 == 0, "definition").otherwise("need_ref").alias("ref_context"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("term")).distinct()
    return references.add_references(r.where("false"), r).select("ref_id")


def eligible_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose nation scored over 0."""
    g = geography(spark, sf_dir)
    u = g.where("depth = 2").select("doc_id", "unit_path", F.when(F.col("ord") % 10 != 0, F.col("parent_unit_path")).otherwise("").alias("org_path"))
    own = g.where("depth = 1").select("doc_id", F.col("unit_path").alias("org_path"), (F.col("unit_id").cast("int") % 3).alias("score"))
    return ranking.eligible(u, own).select("unit_path")


def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are one fact with all their sources."""
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("lang").alias("question_id"), F.coalesce("text", F.lit("")).alias("content"), F.array("source").alias("source_units"), F.col("doc_id").alias("ord"))
    return ranking.merged_sources(f).select("question_id", "ord", F.array_join("source_units", ",").alias("sources"))


def unseen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users (questions) that never had a purchase (unit)."""
    e = table(spark, sf_dir, "events").where("event_id % 7 = 0")
    q = e.select(F.col("user_id").alias("question_id"), F.lit("open").alias("status")).distinct()
    return ranking.unseen(q, e.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("unit_label")), "purchase").select("question_id")


def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events: actions by kind for each user."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('Here: {"actions": [{"action": "'), F.col("event_type"), F.lit('", "id": "'), F.col("event_id"), F.lit('"}, {"action": "request_detail"}]} done'))
    a = analysis.actions(e.select(F.col("user_id"), body.alias("response")), ["user_id"])
    return a.groupBy("user_id", "action").agg(F.count("*").alias("n_actions"), F.count("id").alias("n_ids"))


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' files behind stage 2."""
    o = table(spark, sf_dir, "orders")
    parsed = o.select(F.concat(F.lit("/o/"), F.col("o_orderkey"), F.lit("_parse_output.json")).alias("path"))
    done = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("/o/"), F.col("o_orderkey"), F.lit("_processed.json")).alias("path"), (F.col("o_orderkey") % 3).cast("int").alias("stage_reached"))
    return units.work_list(parsed, done, 2)


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("folder"), F.concat(F.lit("f"), F.col("c_nationkey")).alias("stem"), F.format_string("%08d", F.col("c_custkey")).alias("source"))
    return units.output_names(c).select("source", "output")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents by offset, and a word found again near its place."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    start = F.col("doc_id") % 400
    piece = units.by_offset(F.col("text"), start, start + 12)
    return d.select("doc_id", piece.alias("piece"), units.near_offset(F.col("text"), F.left(F.coalesce(piece, F.lit("\0")), F.lit(6)), start, 40).alias("found_at"))


def stage_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id") % 200
    u = d.select(key.alias("doc"), F.when((F.col("quality") == 1) & (key % 2 == 0), "s").alias("summary_1"), F.when(F.col("toxic") == 1, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("defined_terms"))
    return logs.stage_reached(u, ["doc"])


def level_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each supplier lies in a scope: its region, a region whose key begins alike, and the whole."""
    s = geography(spark, sf_dir).where("depth = 2")
    own = F.regexp_extract("unit_path", "^[^/]*", 0)
    p = F.col("unit_path")
    return s.select(p, tree.in_scope(p, own).alias("in_region"), tree.in_scope(p, F.left(own, F.lit(6))).alias("in_prefix"), tree.in_scope(p, F.lit("")).alias("in_all"), F.size(tree.ancestors(p)).alias("n_above"))


def type_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("ref_id"), F.element_at(F.array(*map(F.lit, ["5 U.S.C. 1", "the Regulation", "Directive (EU)", "other"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref_text"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, ["uslm", "cfr", "formex", "ca_html"])), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("parser_type"))
    return references.type_hint(r, c).groupBy("doc_id").agg(F.count("*").alias("n_refs"))


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, shortened texts and lists as they are shown."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    items = F.slice(F.array("lang", "source", F.col("doc_id").cast("string")), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", tx.truncate(F.col("text"), 40).alias("short"), tx.oxford_list(items).alias("listed"), tx.token_estimate(F.col("text")).alias("tokens"), F.md5(tx.excerpt(F.col("text"), 500)).alias("excerpt"))


QUERIES = {
    "duplicates_settled": duplicates_settled, "metadata_suffix": metadata_suffix, "targets_capped": targets_capped, "scored_levels": scored_levels, "levels_in_scope": levels_in_scope, "compound_paths": compound_paths,
    "indirect_definitions": indirect_definitions, "registry_upsert": registry_upsert, "registry_add_references": registry_add_references, "eligible_units": eligible_units, "merged_facts": merged_facts, "unseen_questions": unseen_questions,
    "action_counts": action_counts, "work_list": work_list, "output_names": output_names, "offsets": offsets, "stage_reached": stage_reached, "level_scope": level_scope, "type_hints": type_hints, "display": display,
}
ORACLES = {
    "duplicates_settled": "WITH p AS (SELECT p_brand, p_size::VARCHAR AS i, p_partkey AS k, p_partkey % 3 <> 0 AS has FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY p_brand, i ORDER BY k) AS n, bool_or(has) OVER (PARTITION BY p_brand, i) AS any_text, sum(has::INT) OVER (PARTITION BY p_brand, i ORDER BY k) AS r FROM p) SELECT p_brand, i || CASE WHEN has THEN repeat('_dup', (r - 1)::BIGINT) ELSE '' END AS unit_id, k AS ord FROM w WHERE has OR (NOT any_text AND n = 1)",
    "metadata_suffix": _SUFFIX_SQL,
    "targets_capped": _TARGETS_SQL,
    "scored_levels": f"WITH {GEOGRAPHY_SQL} SELECT unit_path AS org_path, (CASE WHEN depth < 2 THEN unit_id::INT % 2 ELSE 1 END)::INT AS score FROM geography WHERE NOT (depth = 2 AND split_part(split_part(unit_path, '/', 1), '_', 2)::INT % 2 = 0 AND TRY_CAST(split_part(split_part(unit_path, '/', 2), '_', 2) AS INT) % 2 = 0)",
    "levels_in_scope": _SCOPE_SQL,
    "compound_paths": f"WITH {GEOGRAPHY_SQL} SELECT unit_id AS ref_id, CASE WHEN ord % 4 <> 0 THEN unit_path END AS found_path FROM geography WHERE depth = 2",
    "indirect_definitions": "SELECT p_partkey AS def_id, CASE WHEN p_partkey % 12 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN (SELECT q.p_name FROM part q WHERE q.p_partkey = part.p_partkey - 1) ELSE p_name END AS value, CASE WHEN p_partkey % 12 = 0 THEN 'external' ELSE 'unit' END AS location_kind FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 12 = 0 OR EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey - 1)",
    "registry_upsert": "SELECT n_nationkey::BIGINT AS doc_id, n_name AS file_path, n_name AS metadata, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS stage_reached FROM nation UNION ALL SELECT n_nationkey + 200, n_name || '!', 'm', 3 FROM nation WHERE n_nationkey < 10",
    "registry_add_references": "SELECT min((l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey) AS ref_id FROM lineitem GROUP BY l_suppkey % 10, l_partkey % 20, l_orderkey % 7, l_linenumber % 2, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0 THEN l_returnflag END",
    "eligible_units": f"WITH {GEOGRAPHY_SQL} SELECT g.unit_path FROM geography g JOIN geography n ON n.unit_path = g.parent_unit_path WHERE g.depth = 2 AND (g.ord % 10 = 0 OR n.unit_id::INT % 3 > 0)",
    "merged_facts": r"SELECT lang AS question_id, min(doc_id) AS ord, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY lang, lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[“”‘’`]', chr(34), 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))",
    "unseen_questions": "SELECT user_id AS question_id FROM events WHERE event_id % 7 = 0 GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0",
    "action_counts": "SELECT user_id, event_type AS action, count(*) AS n_actions, count(*) AS n_ids FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'request_detail', count(*), 0 FROM events GROUP BY 1",
    "work_list": "SELECT '/o/' || o_orderkey || '_parse_output.json' AS path, 1 AS stage_reached FROM orders WHERE o_orderkey % 3 <> 2",
    "output_names": "SELECT format('{:08d}', c_custkey) AS source, 'f' || c_nationkey || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS output FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)",
    "offsets": "WITH d AS (SELECT doc_id, text, doc_id % 400 AS s FROM documents WHERE len(text) > 0), p AS (SELECT *, CASE WHEN s + 12 <= len(text) THEN substr(text, s + 1, 12) END AS piece, greatest(0, s - 20) AS a FROM d), f AS (SELECT *, instr(substr(text, a + 1, least(len(text), s + 20) - a), left(coalesce(piece, chr(0)), 6)) AS hit FROM p) SELECT doc_id, piece, CASE WHEN hit > 0 THEN a + hit - 1 END AS found_at FROM f",
    "stage_reached": "SELECT doc_id % 200 AS doc, CASE WHEN bool_or(coalesce(quality = 1, false) AND doc_id % 2 = 0) THEN 3 WHEN bool_or(coalesce(toxic = 1, false)) THEN 2 ELSE 1 END AS stage_reached FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "level_scope": f"WITH {GEOGRAPHY_SQL} SELECT unit_path, true AS in_region, false AS in_prefix, true AS in_all, 3 AS n_above FROM geography WHERE depth = 2",
    "type_hints": "SELECT n_nationkey AS doc_id, (SELECT count(*) FROM part WHERE p_partkey % 4 = 3) + CASE n_nationkey % 4 WHEN 3 THEN 0 ELSE (SELECT count(*) FROM part WHERE p_partkey % 4 = n_nationkey % 4) END AS n_refs FROM nation",
    "display": "SELECT doc_id, CASE WHEN len(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang WHEN 2 THEN lang || ' and ' || source ELSE lang || ', ' || source || ', and ' || doc_id END AS listed, len(text) // 4 AS tokens, md5(CASE WHEN len(text) > 500 THEN left(text, 500) || ' [...]' ELSE text END) AS excerpt FROM documents WHERE text IS NOT NULL",
}

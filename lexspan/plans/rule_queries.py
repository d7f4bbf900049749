"""Rules for terms, queues, registries, caches, logs and model calls over driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import analysis, cache, chunking, definitions, diff, jobs, logs, model, outline, ranking, references, registry, scopes, status, tree, units
from lexspan.plans._tables import GEOGRAPHY_SQL, geography, table
from lexspan.sources.markup import last_json

_NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _pick(c: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _sql_pick(c: str, *values: str) -> str:
    return f"""[{", ".join("'" + v.replace("'", "''") + "'" for v in values)}][({c}) % {len(values)} + 1]"""


# texts and terms

_ODD = ['"quoted"', "**bold**", "_under_", "'\"two\"'", "plain", '""""""""""ten""""""""""', '"open']
_ODD_IS = ["quoted", "bold", "under", "two", "plain", "ten", '"open']
_TERMS = ["the Act", "An  act ", "a term", "Sub-section", "subsection", "city", "Article", "[note", "tail]", "-- line", "A"]


def term_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a few terms: each function's result for each part's term."""
    t = _pick(F.col("p_partkey"), *_TERMS)
    p = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    c = F.col("t")
    return p.select("p_partkey", tx.strip_sub_prefix(c).alias("sub"), tx.normalize_term_loose(c).alias("loose"), tx.plural_of(c).alias("plural"), tx.drop_unbalanced_brackets(c).alias("brackets"), tx.clean_summary_text(c).alias("summary"), tx.strip_emphasis(_pick(F.col("p_partkey"), *_ODD)).alias("bare"))


def paths_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsers hinted at by paths, depths of identifiers, lists, filters."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(_pick(k, "/USC/t", "/x/cfr-", "/eu/", "/ca_gov/", "/other/"), k.cast("string"))
    ident = F.concat(F.lit("/us/usc/t"), k.cast("string"), F.when(k % 2 == 0, "/s1").otherwise(""))
    asked = tx.filter_map(F.concat(F.lit("title="), k.cast("string"), F.lit(",part=p"), (k % 7).cast("string")))
    return o.select(k.alias("o_orderkey"), tx.parser_of_path(path).alias("parser"), tx.indent_of_identifier(ident).alias("indent"), asked["title"].alias("title"), asked["part"].alias("part"), tx.attribute_key(ident).alias("key"))


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their blank lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chunking.drop_blank_lines(t, [])[0] for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return d.mapInArrow(run, "doc_id long, text string").select("doc_id", F.md5("text").alias("text"))


# trees and scopes


def level_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geography(spark, sf_dir).select(F.col("type_key").alias("level_type"))
    return tree.level_names(g)


def units_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 2, suppliers, and units with a text below the top, counted by what they are."""
    g = geography(spark, sf_dir).withColumn("text", F.when(F.col("ord") % 2 == 0, F.col("unit_title")).otherwise(""))
    n = lambda df, name: df.groupBy(F.lit(name).alias("what")).agg(F.count("*").alias("n_units"), F.min("unit_path").alias("least"))
    return n(tree.children(g, "region_2"), "children").unionByName(n(tree.of_type(g, "supplier"), "suppliers")).unionByName(n(tree.text_below(g), "texts"))


def next_type_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.when(F.col("p_brand") != "Brand#11", (F.col("p_size") + 3).cast("string")).alias("param_key"))
    return tree.next_type_key(p)


def current_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths down to the nation of each supplier's context, and to a level that it lacks."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    step = lambda t, c: F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("id"))
    context = F.array(step("region", "n_regionkey"), step("nation", "n_nationkey"))
    return s.select("s_suppkey", scopes.current(context, F.lit("nation")).alias("nation"), scopes.current(context, F.lit("part")).alias("part"))


def definitions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each brand and size, asked for with another spelling."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("location_path"), F.lit("The Term").alias("term"), F.col("p_partkey").alias("def_id"), F.col("p_name").alias("value"))
    w = p.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("doc_id"), (F.col("p_size") + 1).cast("string").alias("location_path"), F.lit("term").alias("term"))
    return scopes.definitions_at(w, d)


def sub_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), "Paragraph", "clause", "section", "subclause").alias("type_key"))
    return scopes.undeclared_sub_types(t, spark.createDataFrame([("clause",)], "type_key string")).select("p_partkey", "type_key")


def conflicting_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size with different types, every fifth an elaboration: each part's class, which is
    the first part of its type there, and how many parts have another type."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("location_path"), F.lit("a term").alias("term"), F.col("p_partkey").alias("def_id"), F.col("p_type").alias("value"), F.when(F.col("p_partkey") % 5 == 0, "elaboration").alias("def_kind"))
    return definitions.conflict_classes(d).select("def_id", "class_id", "n_links")


def needed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of parts that customers need, by name, in quotes and other case."""
    found = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), (F.col("p_partkey") % 50).cast("string").alias("unit_path"), F.col("p_name").alias("term"), F.col("p_partkey").alias("def_id"))
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lit(0).alias("doc_id"), (F.col("p_partkey") % 50).cast("string").alias("unit_path"), F.concat(F.lit('"'), F.upper("p_name"), F.lit('"')).alias("ref_value"))
    return definitions.needed(found, p).select("def_id")


def sources_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with where they come from, unless that is the unit itself."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, k).when(F.col("p_partkey") % 3 == 1, F.lit("9"))
    p = p.withColumn("scope", F.when(F.col("p_partkey") % 2 == 0, " x ").otherwise("  "))
    return p.select("p_partkey", units.with_source(F.col("p_name"), F.lit("section"), source, F.lit("section"), k).alias("value"), definitions.express_scope(p).alias("scoped"))


# the registry


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    null = lambda t: F.lit(None).cast(t)
    return o.select(k.alias("ref_id"), (F.col("o_custkey") % 20).alias("source_doc_id"), F.lit("section").alias("source_item_type"), (k % 30).cast("string").alias("source_item_number"), F.concat((k % 9 + 1).cast("string"), F.lit(" U.S.C. "), (k % 40).cast("string")).alias("ref_text"), _pick(k, "unresolved", "not_in_corpus", "resolved", "ambiguous").alias("status"), F.when(k % 4 == 2, k % 10).alias("target_doc_id"), null("string").alias("target_item_type"), null("string").alias("target_item_number"), null("string").alias("resolution_method"), null("timestamp").alias("resolved_at"), F.lit("n").alias("notes"))


_REFS_SQL = f"refs AS (SELECT o_orderkey AS k, o_custkey % 20 AS d, (o_orderkey % 30)::VARCHAR AS i, {_sql_pick('o_orderkey', 'unresolved', 'not_in_corpus', 'resolved', 'ambiguous')} AS s, CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey % 10 END AS t FROM orders)"


def registry_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference resolved, one marked and one reset; a document's and some items' references gone."""
    r = _refs(spark, sf_dir)
    r = registry.resolved(r, 4, 7, "section", "12", "manual", F.expr(_NOW))
    r = registry.reset(registry.marked(r, 5, "ambiguous", "two"), 6)
    r = registry.without_document(r, 3)
    items = spark.createDataFrame([(4, "section", "7"), (5, "section", "8")], "source_doc_id long, source_item_type string, source_item_number string")
    return registry.without_items(r, items).select("ref_id", "status", "target_doc_id", "target_item_number", "notes")


def registry_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.selected(_refs(spark, sf_dir), 2, "ambiguous").select("ref_id", "ref_text")


def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.stats(table(spark, sf_dir, "nation"), _refs(spark, sf_dir))


def registry_by_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(_pick(F.col("n_nationkey"), "uslm", "cfr", "formex").alias("parser_type"), (F.col("n_regionkey") % 4).alias("stage_reached"))
    return registry.by_parser(n)


def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of nations to regions, added twice; then each nation with its parent."""
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("parent_doc_id"), F.col("n_nationkey").alias("child_doc_id"), F.lit("old").alias("split_type"))
    new = n.where("n_nationkey < 20").select(F.col("n_regionkey").alias("parent_doc_id"), F.col("n_nationkey").alias("child_doc_id"), F.lit("new").alias("split_type"))
    links = registry.links_added(old, new.unionByName(new))
    return references.split_parents(n.select(F.col("n_nationkey").alias("doc_id")), links).join(links.select(F.col("child_doc_id").alias("doc_id"), "split_type"), "doc_id", "left")


def external_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External needs and definitions' references, each once."""
    li = table(spark, sf_dir, "lineitem")
    need = li.select((F.col("l_suppkey") % 5).alias("doc_id"), F.lit("u").alias("unit_path"), _pick(F.col("l_linenumber"), "External", "Need_Definition").alias("ref_type"), (F.col("l_partkey") % 40).cast("string").alias("ref_value"))
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("doc_id"), F.lit("x").alias("location_path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("external_reference"), F.col("p_type").alias("term"))
    return registry.extracted(need, d)


def retried_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References not found before, tried again over titles 1 to 5, each with sections 0 to 19."""
    corpus = spark.range(1, 6).select(F.col("id").alias("doc_id"), F.concat(F.lit("/f"), F.col("id")).alias("file_path"), F.lit("uslm").alias("parser_type"), F.lit(1).alias("stage_reached"), F.create_map(F.lit("title"), F.array(F.col("id").cast("string"))).alias("org_keys"), F.create_map(F.lit("section"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: x.cast("string"))).alias("content_items"))
    got = references.retry(_refs(spark, sf_dir), corpus)
    return got.select("ref_id", "status", "target_doc_id", "target_item_number", "score")


def cross_document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that suppliers of a score refer to, beside those known."""
    s = table(spark, sf_dir, "supplier").select(F.lit("Section").alias("type_name"), F.col("s_suppkey").cast("string").alias("unit_id"), (F.col("s_suppkey") % 3).alias("score"))
    li = table(spark, sf_dir, "lineitem")
    refs = li.select(F.lit("section").alias("source_type"), F.col("l_suppkey").cast("string").alias("source_number"), F.lit(1).alias("target_doc_id"), F.lit("Order").alias("target_type"), F.col("l_orderkey").cast("string").alias("target_number"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lit(1).alias("doc_id"), F.lit("ORDER").alias("type_name"), F.col("o_orderkey").cast("string").alias("unit_id"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.lit(1).alias("doc_id"), F.lit("order").alias("type_name"), F.col("o_orderkey").cast("string").alias("unit_id"), F.lit(3).alias("score"))
    return analysis.cross_document_units(refs, s, o, known).select("unit_id", "score")


# queues, caches, logs


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    null = lambda t: F.lit(None).cast(t)
    return e.select(F.col("event_id").alias("id"), _pick(F.col("event_id"), "queued", "running", "completed", "failed", "cancelled").alias("status"), F.col("event_type").alias("job_type"), F.concat(F.lit("in/u"), F.col("user_id")).alias("file_path"), F.date_trunc("second", F.col("ts")).alias("created_at"), null("timestamp").alias("started_at"), null("timestamp").alias("completed_at"), null("string").alias("worker_id"), null("string").alias("error_message"), F.lit(0).alias("retry_count"), F.lit(1).alias("max_retries"))


def jobs_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each user and kind that has none waiting or running, and for some new files."""
    e = table(spark, sf_dir, "events")
    new = e.select(F.concat(F.lit("./in//u"), F.col("user_id")).alias("file_path"), F.lit("purchase").alias("job_type"), F.lit(2).alias("max_retries")).distinct()
    got = jobs.enqueue(_jobs(spark, sf_dir), new.unionByName(new), F.expr(_NOW))
    return got.where(F.col("created_at") == F.expr(_NOW)).select("id", "file_path", "status", "retry_count", "max_retries")


def jobs_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of every third id completed, of every seventh cancelled; pages of 50 that the states fill."""
    j = _jobs(spark, sf_dir)
    j = jobs.completed(j, j.where("id % 3 = 0").select("id"), F.expr(_NOW))
    j = jobs.cancelled(j, j.where("id % 7 = 0").select("id"), F.expr(_NOW))
    return j.groupBy("status", F.col("completed_at").isNotNull().alias("done")).agg(F.count("*").alias("n_jobs"), jobs.page_count(F.count("*")).alias("n_pages"))


def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("job_id"), F.lit("old").alias("phase"), F.lit(1).alias("items_done"), F.lit(9).alias("total_items"), F.expr(_NOW).alias("timestamp"))
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("job_id"), F.lit("new").alias("phase"), (F.col("r_regionkey") + 2).alias("items_done"), F.lit(9).alias("total_items"))
    return jobs.progress_updated(p, new, F.expr(_NOW)).select("id", "job_id", "phase", "items_done")


def salvaged_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged cache file for each customer: whole entries come back, the torn last one doesn't."""
    c = table(spark, sf_dir, "customer")
    key = lambda x: F.sha2(F.concat(F.lit(x), F.col("c_custkey").cast("string")), 256)
    value = F.concat(F.lit('{"'), key("a"), F.lit('": {"response": "say \\"'), F.col("c_name"), F.lit('\\""}, "'), key("b"), F.lit('": {"response": "cut'))
    return cache.salvaged(c.select(value.alias("value")))


def cache_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("ctx").alias("full_cache"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("prompt"), F.col("user_id").cast("string").alias("response"))
    return cache.from_log(e, "m", "^purchase")


def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("response"))
    return status.cache_stats(c)


def call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of events, by what their prompts and answers say."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    ctx = _pick(k, "Scratch Document", "", "Please evaluate it")
    prompt = _pick(k, "Your Portion", "REFINEMENT PASS of Your Portion", "Consolidate them by removing redundant", "is it meaningfully referenced", "extract **defined terms**")
    answer = _pick(k, "ok", "[2]", "none", "[7]")
    return e.select("event_id", logs.is_analyst(ctx, prompt).alias("analyst"), logs.is_compaction(ctx, prompt).alias("compaction"), logs.is_implicit_detection(prompt).alias("implicit"), logs.is_refinement(prompt).alias("refinement"), logs.is_scoring(ctx, prompt, answer).alias("scoring"), logs.task_of(prompt).alias("task"))


def entries_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions made of a user's events in order, folded into a scratch list."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    body = _pick(k, '{"action":"add_entry","entry":{"type":"question","id":"q1","content":"why"}}', '{"action":"add_answer","question_id":"q1","answer":{"content":"so"}}', '{"action":"add_entry","entry":{"type":"fact","id":"f1","content":"F"}}', '{"action":"add_answer","question_id":"q9","answer":{"content":"no"}}', '{"action":"add_entry","entry":{"type":"fact","content":"no id"}}')
    a = analysis.actions(e.select((F.col("user_id") % 40).alias("user"), k.alias("at"), body.alias("response")), ["user", "at"])
    rows = a.drop("ord").withColumnRenamed("at", "ord").withColumn("unit_label", F.concat(F.lit("unit "), F.col("ord").cast("string")))
    return analysis.applied(rows, ["user"]).groupBy("user", "kind").agg(F.count("*").alias("n"), F.min("source").alias("source"), F.max("id").alias("id"))


def scratch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, questions, answers and requests of actions made of events."""
    e = table(spark, sf_dir, "events")
    body = _pick(F.col("event_id"), '[{"action":"add_entry","entry":{"type":"question","id":"q","content":"c"}},{"action":"request_detail","target_type":"section","target_number":"4"}]', '{"action":"add_entry","entry":{"type":"odd","id":"x","content":"d"}}', '{"action":"add_answer","answer":{"id":"a","content":"e"}}', "no json here")
    a = analysis.actions(e.select("event_id", body.alias("response")), ["event_id"])
    return analysis.entries(a, ["event_id"]).select("event_id", "kind", "content")


def compaction_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names before and after a compaction that changes case everywhere and some names."""
    p = table(spark, sf_dir, "part")
    a = p.select("p_brand", F.col("p_name").alias("content"))
    b = p.select("p_brand", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.upper("p_name")).alias("content"))
    return analysis.compaction(a, b, ["p_brand"]).groupBy("p_brand", "change").agg(F.countDistinct("content").alias("n_facts"))


def final_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What final answers are asked from, for each region."""
    n = table(spark, sf_dir, "nation")
    facts = n.where("n_regionkey < 3").select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("content"), F.array(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source_units"))
    q = n.select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text"), _pick(F.col("n_nationkey"), "open", "answered", "unanswerable").alias("status"))
    return analysis.answer_blocks(facts, q, ["n_regionkey"])


def fact_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as facts of their regions, as many of the newest as 160 characters hold."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.format_string("f%03d", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("content"), F.array(F.lit("u")).alias("source_units"))
    return ranking.fact_pool(n, ["n_regionkey"], 160).select("id", "line")


def unit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations read with their suppliers as definitions, and neighbours' names."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    u = n.select(F.lit(0).alias("doc_id"), F.col("n_nationkey").cast("string").alias("unit_path"), F.col("n_name").alias("title"))
    d = s.where("s_suppkey <= 40").select(F.lit(0).alias("doc_id"), F.col("s_nationkey").cast("string").alias("unit_path"), F.format_string("t%04d", F.col("s_suppkey")).alias("term"), F.col("s_name").alias("value"))
    r = n.where("n_nationkey % 2 = 0").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").cast("string").alias("unit_path"), F.lit("next").alias("target_path"), F.col("n_name").alias("summary_1"))
    p = n.where("n_nationkey % 5 = 0").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").cast("string").alias("unit_path"), F.lit("p").alias("term"), F.lit("q").alias("value"))
    return analysis.contexts(u, d, r, p).select("unit_path", "context")


# status and listings

_STATUS = "doc_id int, phase_2 string, complete_2 boolean, complete_3 boolean, last_item string, total_2 int, done_2 int, total_op int, first_op int, second_op int, total_org int, second_org int, since_checkpoint int"


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' documents start, get through both stages more or less, and count their suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey")
    st = status.with_status(spark.createDataFrame([], _STATUS), n.select(k.alias("doc_id")))
    st = status.stage_2_updated(st, n.where("n_nationkey < 20").select(k.alias("doc_id"), (k % 4).alias("total_2"), F.lit(2).alias("done_2"), F.lit("scopes").alias("phase_2"), F.when(k % 7 == 0, False).alias("set_complete")))
    st = status.stage_3_updated(st, n.where("n_nationkey > 4").select(k.alias("doc_id"), (k % 3).alias("total_op"), F.lit(None).cast("int").alias("first_op"), F.lit(1).alias("second_op"), (k % 2).alias("total_org"), F.lit(0).alias("second_org")))
    st = status.items_done(st, s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("item")))
    due = status.checkpoint_due(st, 4).select("doc_id", F.lit(True).alias("due"))
    return st.join(due, "doc_id", "left").select("doc_id", "phase_2", "complete_2", "complete_3", "last_item", "total_2", "since_checkpoint", F.coalesce("due", F.lit(False)).alias("due"))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.format_string("%08d", F.col("o_orderkey")).alias("path"), _pick(F.col("o_orderkey"), "processed", "skipped", "failed").alias("outcome"), F.when(F.col("o_orderkey") % 2 == 0, "bad").alias("error"), F.lit(2).alias("seconds"))
    return status.run_counters(o, 3).withColumn("errors", F.array_join("errors", "; "))


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_pick(F.col("o_orderkey"), "uslm", "cfr").alias("parser_type"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 3).cast("int")).alias("stage_reached"))
    return status.document_statistics(o)


def documents_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.select(F.concat(F.lit("/o/"), F.col("o_orderkey"), F.lit("_parse_output.json")).alias("path"))
    p = o.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("/o/"), F.col("o_orderkey"), F.lit("_processed.json")).alias("path"), (F.col("o_orderkey") % 4).cast("int").alias("stage_reached"))
    return status.documents_listed(m, p).select("path", "state")


def customers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name or segment holds a string, case aside."""
    return status.matching(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], " BUILD").select("c_custkey")


def questions_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("title"), (F.col("c_custkey") % 2 == 0).alias("complete"), F.col("c_name").alias("file_name"))
    return status.questions_shown(c, "BUILDING", True)


def unit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.unit_page(geography(spark, sf_dir), 20, 10, "supplier", "1").select("unit_path")


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' manifests of nations' files: even ones come again, twice, and some are new."""
    n = table(spark, sf_dir, "nation")
    row = lambda kind, levels, title: [F.col("n_regionkey").alias("manifest"), F.col("n_name").alias("file"), F.lit(kind).alias("kind"), levels.alias("levels"), title.alias("short_title")]
    old = n.where("n_nationkey < 20").select(*row("full", F.concat(F.lit("l"), "n_nationkey"), F.lit("old")))
    new = n.where("n_nationkey % 2 = 0")
    twice = new.select(*row("split", F.lit("first"), F.lit("gone")), F.lit(1).alias("ord")).unionByName(new.select(*row("split", F.when(F.col("n_nationkey") % 4 == 0, "second"), F.lit("new")), F.lit(2).alias("ord")))
    return status.files_added(old, twice)


def types_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that brands have parts of, and the keys of types named otherwise."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("type_key"))
    types = p.select("doc_id").distinct().crossJoin(spark.range(0, 60, 7).select(F.col("id").cast("string").alias("type_key"))).withColumns({"type_name": F.concat(F.lit("Type "), "type_key"), "operational": (F.col("type_key").cast("int") % 2).alias("operational")})
    used = status.without_empty_types(types, p)
    return status.type_named(used, used.select("doc_id", F.upper("type_name").alias("type_name")))


def levels_to_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    levels = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("title"), F.lit("1"), F.lit("part"), F.lit("2"))).otherwise(F.create_map(F.lit("title"), F.lit("1")))
    return status.filterable_levels(n.select(levels.alias("levels")))


def quoted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' parts as lists: how many of the first eight items open with a quotation mark."""
    p = table(spark, sf_dir, "part")
    lists = p.groupBy(F.col("p_brand").alias("list_id")).agg(F.sum(F.length("p_name")).alias("n_chars"), F.when(F.max("p_partkey") % 3 != 0, "c").alias("chapeau"))
    items = p.select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("ord"), F.concat(_pick(F.col("p_partkey"), '"', "", " “"), "p_name").alias("text"))
    return status.quoted_candidates(lists, items, 500, 30).select("list_id", "n_items", "n_quoted", "n_sample")


def sources_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files whose hash in the manifest is another's."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("content"), F.col("c_custkey"))
    m = c.select("path", F.sha2(F.concat("content", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("")), 256).alias("source_hash"))
    return diff.sources_changed(m, c).select("path")


# model calls, answered by the stub


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, response string")


def _hex(context: str, prompt: str) -> str:
    return f"sha256(({context}) || chr(31) || ({prompt}))"


def _byte(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {2 * i + 1}, 2))::INT"


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("nation").alias("type_key"), F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_name").alias("summary"))
    return model.relevance(n, "why?", _none(spark), model.Stub())


def first_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("doc_id"), F.col("s_suppkey").cast("string").alias("unit_path"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise(" ").alias("text"))
    return model.summaries(s, _none(spark), model.Stub()).select("unit_path", "summary_1")


def second_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("doc_id"), F.col("s_suppkey").cast("string").alias("unit_path"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("text"), F.lit("one").alias("summary_1"), "s_nationkey")
    context = s.where("s_nationkey < 12").select("doc_id", "unit_path", F.concat(F.lit("nation "), F.col("s_nationkey")).alias("context"))
    return model.second_summaries(s.drop("s_nationkey"), context, _none(spark), model.Stub()).select("unit_path", "summary_2")


def table_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").cast("string").alias("table_key"), F.repeat("n_name", F.lit(2000)).alias("table_html"), F.lit(3).alias("row_count"), F.array(F.lit("h")).alias("headers"))
    return model.table_summaries(n, _none(spark), model.Stub()).select("table_key", "summary_1")


def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of nations' suppliers as chunks: of each term the first chunk counts."""
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("doc_id"), F.col("s_nationkey").cast("string").alias("unit_path"), F.col("s_suppkey").alias("chunk_no"), F.col("s_name").alias("text"))
    return model.defined_terms(s, _none(spark), model.Stub()).select("unit_path", "term", "chunk_no", "value")


def definitions_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as definitions, judged once each and joined back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source_path"), F.lit("t").alias("term"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("value"))
    return model.judged_once(p, _none(spark), model.Stub()).select("p_partkey", "good", "improved")


def pairs_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and the next ones, in either order."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.lit("t").alias("term"), F.col("n_name").alias("one"), F.lead("n_name").over(Window.orderBy("n_nationkey")).alias("two")).where("two IS NOT NULL")
    both = a.unionByName(a.select("term", F.col("two").alias("one"), F.col("one").alias("two")))
    return model.pairs_judged(both, _none(spark), model.Stub()).select("one", "two", "elaborates")


def references_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as ambiguous references among their nations."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ref_id"), F.col("r_name").alias("ref_text"))
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("ref_id"), F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("title"))
    return model.picked(r, c, _none(spark), model.Stub())


def values_from_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    w = n.select(F.col("n_nationkey").alias("ref_id"), F.lit(0).alias("doc_id"), F.col("n_regionkey").cast("string").alias("target_path"), F.col("n_name").alias("term"))
    t = table(spark, sf_dir, "region").select(F.lit(0).alias("doc_id"), F.col("r_regionkey").cast("string").alias("unit_path"), F.when(F.col("r_regionkey") != 1, F.col("r_name")).alias("text"))
    return model.values_from_targets(w, t, _none(spark), model.Stub())


def analysis_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question's queue over the nations: which units were asked in which wave."""
    n = table(spark, sf_dir, "nation").select(F.lit("unit").alias("type_key"), F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_name").alias("summary"))
    return model.analyse(n, "why?", model.Stub(), _none(spark), waves=2)[2].select("wave", "unit_id")


def analysis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the first two waves found."""
    n = table(spark, sf_dir, "nation").select(F.lit("unit").alias("type_key"), F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_name").alias("summary"))
    return model.analyse(n, "why?", model.Stub(), _none(spark), waves=2)[1].select("id", "wave", "unit_id", "content")


def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer from the regions as facts, and whether it stood the check."""
    f = table(spark, sf_dir, "region").select(F.format_string("f%03d", F.col("r_regionkey")).alias("id"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(0).alias("wave"), F.lit("u").alias("unit_id"), F.col("r_name").alias("content"))
    return model.final_answer(f, "why?", model.Stub(), _none(spark))


def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of conversations with tools, and of none with a system text."""
    c = table(spark, sf_dir, "customer")
    key = model.messages_key(F.array(F.col("c_name"), F.lit("hi")), F.array(F.lit("look")), F.when(F.col("c_custkey") % 2 == 0, "sys"))
    return c.select("c_custkey", key.alias("key"))


def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last JSON that texts made of events hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([last_json(t) for t in b.column(1).to_pylist()], pa.string())], names=["event_id", "said"])

    k = F.col("event_id")
    text = F.concat(F.lit('first {"a": 1} then '), F.when(k % 3 == 0, F.concat(F.lit('[{"b": '), k.cast("string"), F.lit("}] done"))).when(k % 3 == 1, F.lit('{"torn": ')).otherwise(F.lit("nothing")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).mapInArrow(run, "event_id long, said string")


def shown_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File sizes, file name suffixes, cleaned titles and prompts for chunks."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    levels = F.create_map(F.lit("title"), k.cast("string"), F.lit("part"), F.when(k % 2 == 0, "7").otherwise(""))
    prompt = model.chunk_prompt(F.lit("base"), F.col("p_name"), (k % 3 + 1), k % 3 + 1, F.when(k % 2 == 0, "old").otherwise(""))
    return p.select("p_partkey", tx.file_size(k % 1000 * 1024).alias("size"), outline.unit_suffix(levels).alias("suffix"), outline.clean_title(F.concat(F.lit(" —"), "p_name", F.lit(".: "))).alias("title"), prompt.alias("prompt"), model.gated(F.when(k % 3 == 0, "merge").when(k % 3 == 1, "odd"), "request").alias("gate"))


_WAVES_SQL = f"""n AS (SELECT n_nationkey::VARCHAR AS u, n_name AS s, {_byte(_hex("'relevance: why?'", "n_name"), 0)} % 4 AS score FROM nation),
w0 AS (SELECT u, s, {_hex("'why?'", "s")} AS h FROM n WHERE score = 3),
f0 AS (SELECT min(u) AS u, substr(h, 1, 12) AS c FROM w0 WHERE {_byte("h", 1)} % 2 = 0 GROUP BY 2), i0 AS (SELECT row_number() OVER (ORDER BY u) AS i, u, c FROM f0),
asked AS (SELECT DISTINCT ({_byte("h", 3)} % 32)::VARCHAR AS u FROM w0 WHERE {_byte("h", 2)} % 4 = 0),
more AS (SELECT n.* FROM n JOIN asked USING (u) WHERE u NOT IN (SELECT u FROM w0)),
t AS (SELECT 'why?' || coalesce(chr(10) || string_agg('[' || format('f{{:03d}}', i) || '] ' || c, chr(10) ORDER BY i), '') AS t FROM i0),
w1 AS (SELECT u, s FROM more UNION ALL SELECT u, s FROM n WHERE score = 2 AND NOT EXISTS (SELECT 1 FROM more)),
a1 AS (SELECT u, {_hex("t", "s")} AS h FROM w1, t),
f1 AS (SELECT min(u) AS u, substr(h, 1, 12) AS c FROM a1 WHERE {_byte("h", 1)} % 2 = 0 AND substr(h, 1, 12) NOT IN (SELECT c FROM f0) GROUP BY 2)"""


QUERIES = {
    f.__name__: f
    for f in (
        term_forms, paths_and_ids, blank_lines, level_types, units_below, next_type_keys, current_levels, definitions_at, sub_types, conflicting_pairs, needed_definitions, sources_named, registry_rewrites, registry_selected,
        registry_stats, registry_by_parser, split_links, external_references, retried_references, cross_document_units, jobs_enqueued, jobs_settled, progress_rows, salvaged_cache, cache_from_log, cache_report, call_kinds, entries_applied,
        scratch_entries, compaction_changes, final_blocks, fact_pools, unit_contexts, status_updates, run_report, document_report, documents_listed, customers_found, questions_shown, unit_page, manifest_upsert, types_in_use,
        levels_to_filter, quoted_lists, sources_changed, relevance_scores, first_summaries, second_summaries, table_summaries, defined_terms, definitions_judged, pairs_judged, references_picked, values_from_targets, analysis_waves, analysis_facts,
        final_answers, message_keys, last_answers, shown_forms,
    )
}

_KEY = "sha256('ctx' || chr(10) || chr(10) || '---QUERY---' || chr(10) || chr(10) || event_type || ' ' || event_id || chr(10) || chr(10) || '---MODEL---' || chr(10) || chr(10) || 'm' || chr(10) || chr(10) || '---MAX_TOKENS---' || chr(10) || chr(10) || '0')"
_EVENT_KIND = "event_id % 5"

ORACLES = {
    "term_forms": f"""SELECT p_partkey, {_sql_pick("p_partkey", *[{"Sub-section": "section", "subsection": "section"}.get(t, t) for t in _TERMS])} AS sub, {_sql_pick("p_partkey", "act", " act", "term", "sub-section", "subsection", "city", "article", "[note", "tail]", "-- line", "a")} AS loose,
{_sql_pick("p_partkey", "the acts", "an  act s", "a terms", "sub-sections", "subsections", "citys", "articles", "[notes", "tail]s", "-- lines", "as")} AS plural, {_sql_pick("p_partkey", *[{"[note": "note", "tail]": "tail"}.get(t, t) for t in _TERMS])} AS brackets,
{_sql_pick("p_partkey", *[{"-- line": "line", "An  act ": "An  act"}.get(t, t) for t in _TERMS])} AS summary, {_sql_pick("p_partkey", *_ODD_IS)} AS bare FROM part""",
    "paths_and_ids": f"SELECT o_orderkey, {_sql_pick('o_orderkey', 'uslm', 'cfr', 'formex', 'ca_html', 'unknown')} AS parser, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 3 END AS indent, o_orderkey::VARCHAR AS title, 'p' || o_orderkey % 7 AS part, right('/us/usc/t' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/s1' ELSE '' END, 6) AS key FROM orders",
    "blank_lines": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^\s*\n', '', 'g'), '(^|\n)[ \t]+$', '\1')) AS text FROM documents WHERE text IS NOT NULL",
    "level_types": f"WITH {GEOGRAPHY_SQL} SELECT DISTINCT type_key AS level_type FROM geography",
    "units_below": f"WITH {GEOGRAPHY_SQL} SELECT 'children' AS what, count(*) AS n_units, min(unit_path) AS least FROM geography WHERE parent_unit_path = 'region_2' UNION ALL SELECT 'suppliers', count(*), min(unit_path) FROM geography WHERE depth = 2 UNION ALL SELECT 'texts', count(*), min(unit_path) FROM geography WHERE depth > 0 AND ord % 2 = 0 AND unit_title <> ''",
    "next_type_keys": "SELECT p_brand AS doc_id, CASE WHEN p_brand = 'Brand#11' THEN 10 ELSE max(p_size) + 4 END AS next_key FROM part GROUP BY p_brand",
    "current_levels": "SELECT s_suppkey, 'region_' || n_regionkey || '/nation_' || n_nationkey AS nation, NULL::VARCHAR AS part FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "definitions_at": "SELECT w.p_partkey AS ref_id, min(p.p_partkey) AS def_id, arg_min(p.p_name, p.p_partkey) AS value FROM part w JOIN part p ON p.p_brand = w.p_brand AND p.p_size = w.p_size + 1 GROUP BY 1",
    "sub_types": f"SELECT * FROM (SELECT p_partkey, {_sql_pick('p_partkey', 'Paragraph', 'clause', 'section', 'subclause')} AS type_key FROM part) WHERE type_key IN ('Paragraph', 'subclause')",
    "conflicting_pairs": "SELECT p_partkey AS def_id, CASE WHEN p_type IS NOT NULL THEN min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_type) END AS class_id, CASE WHEN p_type IS NULL THEN 0 ELSE count(p_type) OVER (PARTITION BY p_brand, p_size) - count(*) OVER (PARTITION BY p_brand, p_size, p_type) END AS n_links FROM part WHERE p_partkey % 5 <> 0",
    "needed_definitions": "SELECT p_partkey AS def_id FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 0 AND q.p_partkey % 50 = p.p_partkey % 50 AND lower(q.p_name) = lower(p.p_name))",
    "sources_named": "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN CASE WHEN p_partkey = 9 THEN '' ELSE '(from section 9) ' END ELSE '' END || p_name AS value, p_partkey % 2 = 0 AS scoped FROM part",
    "registry_rewrites": f"WITH {_REFS_SQL} SELECT k AS ref_id, CASE k WHEN 4 THEN 'resolved' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'unresolved' ELSE s END AS status, CASE k WHEN 4 THEN 7 WHEN 6 THEN NULL ELSE t END AS target_doc_id, CASE k WHEN 4 THEN '12' END AS target_item_number, CASE k WHEN 5 THEN 'two' WHEN 6 THEN NULL ELSE 'n' END AS notes FROM refs WHERE d <> 3 AND NOT (d = 4 AND i = '7') AND NOT (d = 5 AND i = '8')",
    "registry_selected": f"WITH {_REFS_SQL} SELECT k AS ref_id, (k % 9 + 1) || ' U.S.C. ' || k % 40 AS ref_text FROM refs WHERE d = 2 AND s = 'ambiguous'",
    "registry_stats": f"WITH {_REFS_SQL} SELECT 'documents' AS name, count(*) AS n FROM nation UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'status ' || s, count(*) FROM refs GROUP BY s",
    "registry_by_parser": f"SELECT {_sql_pick('n_nationkey', 'uslm', 'cfr', 'formex')} AS parser_type, count(*) AS n_docs, count(*) FILTER (WHERE n_regionkey % 4 >= 1) AS n_stage_1, count(*) FILTER (WHERE n_regionkey % 4 >= 2) AS n_stage_2, count(*) FILTER (WHERE n_regionkey % 4 >= 3) AS n_stage_3 FROM nation GROUP BY 1",
    "split_links": "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey < 20 OR n_nationkey % 2 = 0 THEN n_regionkey END AS parent_doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'old' WHEN n_nationkey < 20 THEN 'new' END AS split_type FROM nation",
    "external_references": "SELECT DISTINCT l_suppkey % 5 AS doc_id, 'u' AS source_path, (l_partkey % 40)::VARCHAR AS ref_text, 'need_ref' AS ref_context, NULL::VARCHAR AS term FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT DISTINCT p_partkey % 5, 'x', p_brand, 'definition', p_type FROM part WHERE p_partkey % 3 = 0",
    "retried_references": f"WITH {_REFS_SQL} SELECT k AS ref_id, CASE WHEN k % 9 < 5 THEN 'resolved' ELSE 'not_in_corpus' END AS status, CASE WHEN k % 9 < 5 THEN k % 9 + 1 END AS target_doc_id, CASE WHEN k % 9 < 5 THEN (k % 40)::VARCHAR END AS target_item_number, CASE WHEN k % 9 >= 5 THEN 0 WHEN k % 40 < 20 THEN 5 ELSE 3 END AS score FROM refs WHERE s = 'not_in_corpus'",
    "cross_document_units": "SELECT unit_id, max(score)::INT AS score FROM (SELECT o_orderkey::VARCHAR AS unit_id, 3 AS score FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 2 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_suppkey % 3 > 0)) GROUP BY unit_id",
    "jobs_enqueued": f"WITH f AS (SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.event_id % 5 < 2)) SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY 'in/u' || user_id) AS id, './in//u' || user_id AS file_path, 'queued' AS status, 0 AS retry_count, 2 AS max_retries FROM f",
    "jobs_settled": f"""WITH j AS (SELECT event_id AS id, {_sql_pick('event_id', 'queued', 'running', 'completed', 'failed', 'cancelled')} AS s FROM events), c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' ELSE s END AS s, id % 3 = 0 AS done FROM j),
d AS (SELECT CASE WHEN id % 7 = 0 AND s IN ('queued', 'running') THEN 'cancelled' ELSE s END AS status, done OR (id % 7 = 0 AND s IN ('queued', 'running')) AS done FROM c) SELECT status, done, count(*) AS n_jobs, ceil(count(*) / 50)::BIGINT AS n_pages FROM d GROUP BY 1, 2""",
    "progress_rows": "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS job_id, 'old' AS phase, 1 AS items_done FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey), r_regionkey, 'new', r_regionkey + 2 FROM region",
    "salvaged_cache": "SELECT sha256('a' || c_custkey) AS key, 'say \"' || c_name || '\"' AS response FROM customer",
    "cache_from_log": f"SELECT {_KEY} AS key, user_id::VARCHAR AS response FROM events WHERE event_type = 'purchase'",
    "cache_report": "SELECT count(*) AS n_entries, sum(len(c_custkey::VARCHAR) + CASE WHEN c_custkey % 5 <> 0 THEN len(c_name) ELSE 0 END)::BIGINT AS n_chars, count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_empty FROM customer",
    "call_kinds": f"SELECT event_id, event_id % 3 = 0 AND {_EVENT_KIND} < 2 AS analyst, {_EVENT_KIND} = 2 AS compaction, {_EVENT_KIND} = 3 AS implicit, {_EVENT_KIND} = 1 AS refinement, event_id % 3 = 2 OR event_id % 4 = 1 AS scoring, CASE WHEN {_EVENT_KIND} = 4 THEN 's2.extract_terms' END AS task FROM events",
    "entries_applied": f"""WITH e AS (SELECT user_id % 40 AS u, event_id AS k, {_EVENT_KIND} AS m FROM events), q AS (SELECT u, min(k) AS since FROM e WHERE m = 0 GROUP BY u)
SELECT u AS user, CASE m WHEN 0 THEN 'question' ELSE 'fact' END AS kind, 1 AS n, 'unit ' || max(k) AS source, CASE m WHEN 0 THEN 'q1' ELSE 'f1' END AS id FROM e WHERE m IN (0, 2) GROUP BY u, m
UNION ALL SELECT u, 'answer', count(*), min('unit ' || k), max(format('a_{{:03d}}', r)) FROM (SELECT e.u, k, row_number() OVER (PARTITION BY e.u ORDER BY k) AS r FROM e JOIN q ON q.u = e.u AND k > since WHERE m = 1) GROUP BY u""",
    "scratch_entries": "SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['question', 'request'] WHEN 1 THEN ['fact'] WHEN 2 THEN ['answer'] ELSE [] END) AS kind, unnest(CASE event_id % 4 WHEN 0 THEN ['c', 'section 4'] WHEN 1 THEN ['d'] WHEN 2 THEN ['e'] ELSE [] END) AS content FROM events",
    "compaction_changes": """WITH a AS (SELECT p_brand, p_name AS c, lower(p_name) AS k FROM part), b AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE upper(p_name) END AS c FROM part)
SELECT p_brand, 'dropped' AS change, count(DISTINCT c) AS n_facts FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p_brand = a.p_brand AND lower(b.c) = a.k) GROUP BY 1 UNION ALL SELECT p_brand, 'made', count(DISTINCT c) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.p_brand = b.p_brand AND a.k = lower(b.c)) GROUP BY 1""",
    "final_blocks": f"""WITH n AS (SELECT n_regionkey, n_nationkey AS k, n_name AS t, {_sql_pick('n_nationkey', 'open', 'answered', 'unanswerable')} AS s FROM nation) SELECT n_regionkey, CASE WHEN n_regionkey < 3 THEN string_agg('- ' || t || '  [sources: s, ' || k || ']', chr(10) ORDER BY k) ELSE '(No facts collected.)' END AS facts,
coalesce(string_agg('- [' || upper(s) || '] ' || t, chr(10) ORDER BY k) FILTER (WHERE s <> 'open'), '(No sub-questions were generated.)') AS questions, coalesce(string_agg('- ' || t, chr(10) ORDER BY k) FILTER (WHERE s = 'unanswerable'), '') AS unresolved FROM n GROUP BY n_regionkey""",
    "fact_pools": """WITH l AS (SELECT n_regionkey AS r, format('f{:03d}', n_nationkey) AS id, '[' || format('f{:03d}', n_nationkey) || '] ' || n_name || '  (sources: u)' AS line FROM nation), w AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY r) - 1 AS every, sum(len(line) + 1) OVER (PARTITION BY r ORDER BY id DESC) AS newest FROM l)
SELECT id, line FROM w WHERE every <= 160 OR newest <= 160 - len('Most recent facts (full detail):') - 1""",
    "unit_contexts": """WITH d AS (SELECT s_nationkey AS k, chr(10) || chr(10) || 'Definitions:' || chr(10) || string_agg(format('t{:04d}: ', s_suppkey) || s_name, chr(10) ORDER BY s_suppkey) AS d FROM supplier WHERE s_suppkey <= 40 GROUP BY 1)
SELECT n_nationkey::VARCHAR AS unit_path, n_name || coalesce(d, '') || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || 'Referenced:' || chr(10) || 'next: ' || n_name ELSE '' END || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) || chr(10) || 'Parent definitions:' || chr(10) || 'p: q' ELSE '' END AS context FROM nation LEFT JOIN d ON k = n_nationkey""",
    "status_updates": """WITH s AS (SELECT s_nationkey AS k, count(*) AS n, arg_max(s_name, s_suppkey) AS last FROM supplier GROUP BY 1)
SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey < 20 THEN 'scopes' ELSE 'initialization' END AS phase_2, n_nationkey < 20 AND n_nationkey % 7 <> 0 AND n_nationkey % 4 IN (1, 2) AS complete_2, n_nationkey > 4 AND n_nationkey % 3 <= 1 AND n_nationkey % 2 = 0 AS complete_3, last AS last_item, CASE WHEN n_nationkey < 20 THEN n_nationkey % 4 ELSE 0 END AS total_2, coalesce(n, 0)::INT AS since_checkpoint, coalesce(n, 0) >= 4 AS due FROM nation LEFT JOIN s ON k = n_nationkey""",
    "run_report": """WITH o AS (SELECT format('{:08d}', o_orderkey) AS p, o_orderkey % 3 AS m, o_orderkey AS k FROM orders) SELECT count(*) AS n_files, count(*) FILTER (WHERE m = 0) AS n_processed, count(*) FILTER (WHERE m = 1) AS n_skipped, count(*) FILTER (WHERE m = 2) AS n_failed, (2 * count(*))::BIGINT AS seconds,
(SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT p || ': ' || CASE WHEN k % 2 = 0 THEN 'bad' ELSE 'unknown' END AS x FROM o WHERE m = 2 ORDER BY 1 LIMIT 3)) AS errors FROM o""",
    "document_report": "SELECT 'all' AS name, count(*) AS n FROM orders UNION ALL SELECT 'parser ' || CASE o_orderkey % 2 WHEN 0 THEN 'uslm' ELSE 'cfr' END, count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'stage ' || o_orderkey % 3, count(*) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "documents_listed": "SELECT '/o/' || o_orderkey || '_parse_output.json' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'complete' ELSE 'partial' END AS state FROM orders",
    "customers_found": "SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')",
    "questions_shown": "SELECT c_mktsegment AS title, true AS complete, c_name AS file_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0",
    "unit_page": f"WITH {GEOGRAPHY_SQL} SELECT unit_path FROM geography WHERE depth = 2 AND (contains(unit_id, '1') OR contains(lower(unit_title), '1')) ORDER BY ord LIMIT 20 OFFSET 10",
    "manifest_upsert": "SELECT n_regionkey AS manifest, n_name AS file, CASE WHEN n_nationkey < 20 THEN 'full' ELSE 'split' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'second' WHEN n_nationkey < 20 THEN 'l' || n_nationkey END AS levels, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS short_title FROM nation WHERE n_nationkey < 20 OR n_nationkey % 2 = 0",
    "types_in_use": "SELECT DISTINCT p_brand AS doc_id, 'TYPE ' || p_size AS type_name, CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END AS type_key FROM part WHERE p_size % 7 = 0",
    "levels_to_filter": "SELECT 'title' AS level_type, count(*) AS n_files FROM nation UNION ALL SELECT 'part', count(*) FROM nation WHERE n_nationkey % 2 = 0",
    "quoted_lists": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_brand AS list_id, count(*) AS n_items, count(*) FILTER (WHERE r <= 8 AND p_partkey % 3 <> 1) AS n_quoted, least(count(*), 8) AS n_sample FROM p GROUP BY 1 HAVING sum(len(p_name)) >= 500 AND max(p_partkey) % 3 <> 0 AND count(*) >= 30""",
    "sources_changed": "SELECT c_custkey::VARCHAR AS path FROM customer WHERE c_custkey % 3 = 0",
    "relevance_scores": f"""SELECT 'nation' AS type_key, n_nationkey::VARCHAR AS unit_id, ({_byte(_hex("'relevance: why?'", "n_name"), 0)} % 4)::INT AS score FROM nation""",
    "first_summaries": f"""SELECT s_suppkey::VARCHAR AS unit_path, CASE WHEN s_suppkey % 4 = 0 THEN 'No text.' ELSE substr({_hex("'summarise'", "s_name")}, 1, 12) END AS summary_1 FROM supplier""",
    "second_summaries": f"""SELECT s_suppkey::VARCHAR AS unit_path, CASE WHEN s_suppkey % 4 = 0 THEN 'one' ELSE substr({_hex("CASE WHEN s_nationkey < 12 THEN 'nation ' || s_nationkey ELSE '' END", "s_name")}, 1, 12) END AS summary_2 FROM supplier""",
    "table_summaries": f"""SELECT n_nationkey::VARCHAR AS table_key, substr({_hex("'table structure'", "left(repeat(n_name, 2000), 12000)")}, 1, 12) AS summary_1 FROM nation""",
    "defined_terms": f"""WITH c AS (SELECT s_nationkey AS u, s_suppkey AS k, s_name AS t, {_hex("'terms'", "s_name")} AS h FROM supplier), e AS (SELECT u, k, t, 'term ' || substr(h, 1, 1) AS term FROM c UNION SELECT u, k, t, 'term ' || substr(h, 2, 1) FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY u, term ORDER BY k) AS r FROM e)
SELECT u::VARCHAR AS unit_path, term, k AS chunk_no, substr({_hex("t", "'define: ' || term")}, 1, 12) AS value FROM f WHERE r = 1""",
    "definitions_judged": f"""WITH g AS (SELECT p_partkey, p_partkey % 6 <> 0 AND {_byte(_hex("'quality of t'", "p_type"), 1)} % 2 = 0 AS good, substr({_hex("p_brand", "'improve t'")}, 1, 12) AS i FROM part) SELECT p_partkey, good, CASE WHEN NOT good AND p_partkey % 6 <> 0 THEN i END AS improved FROM g""",
    "pairs_judged": f"""WITH a AS (SELECT n_name AS one, lead(n_name) OVER (ORDER BY n_nationkey) AS two FROM nation), b AS (SELECT one, two FROM a WHERE two IS NOT NULL UNION ALL SELECT two, one FROM a WHERE two IS NOT NULL) SELECT one, two, {_byte(_hex("'t'", "least(one, two) || chr(10) || '---' || chr(10) || greatest(one, two)"), 1)} % 2 = 0 AS elaborates FROM b""",
    "references_picked": f"""WITH l AS (SELECT n_regionkey AS ref_id, n_nationkey AS doc_id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation), p AS (SELECT ref_id, string_agg(n || ': ' || n_name, chr(10) ORDER BY n) AS prompt FROM l GROUP BY 1), c AS (SELECT r_regionkey AS ref_id, {_byte(_hex("r_name", "prompt"), 2)} % 8 AS n FROM region JOIN p ON ref_id = r_regionkey)
SELECT c.ref_id, doc_id, CASE WHEN doc_id IS NULL THEN 'ambiguous' ELSE 'resolved' END AS status FROM c LEFT JOIN l ON l.ref_id = c.ref_id AND l.n = c.n""",
    "values_from_targets": f"""SELECT n_nationkey AS ref_id, substr({_hex("r_name", "'define: ' || n_name")}, 1, 12) AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 1""",
    "final_answers": f"""WITH c AS (SELECT 'why?' || chr(10) || string_agg('[' || format('f{{:03d}}', r_regionkey) || '] ' || r_name, chr(10) ORDER BY r_regionkey) AS c FROM region), a AS (SELECT c, substr({_hex("c", "'answer'")}, 1, 12) AS answer FROM c) SELECT answer, {_byte(_hex("c", "'check: ' || answer"), 1)} % 2 = 0 AS accepted FROM a""",
    "message_keys": """SELECT c_custkey, sha256('{"messages":["' || c_name || '","hi"],"tools":["look"],"system":"' || CASE WHEN c_custkey % 2 = 0 THEN 'sys' ELSE '' END || '"}') AS key FROM customer""",
    "last_answers": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[{"b":' || event_id || '}]' ELSE '{"a":1}' END AS said FROM events""",
    "shown_forms": """SELECT p_partkey, CASE WHEN p_partkey % 1000 = 0 THEN '0 B' ELSE p_partkey % 1000 || '.0 KB' END AS size, '_title' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_part7' ELSE '' END AS suffix, p_name AS title,
CASE p_partkey % 3 WHEN 0 THEN 'base' || chr(10) || chr(10) || p_name ELSE 'base' || chr(10) || chr(10) || 'Part ' || (p_partkey % 3 + 1) || ' of ' || (p_partkey % 3 + 1) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Earlier parts: old' ELSE '' END || chr(10) || chr(10) || p_name END AS prompt, CASE WHEN p_partkey % 3 = 0 THEN 'merge' ELSE 'reject' END AS gate FROM part""",
    "analysis_waves": f"WITH {_WAVES_SQL} SELECT 0 AS wave, u AS unit_id FROM w0 UNION ALL SELECT 1, u FROM w1",
    "analysis_facts": f"WITH {_WAVES_SQL} SELECT format('f{{:03d}}', i) AS id, 0 AS wave, u AS unit_id, c AS content FROM i0 UNION ALL SELECT format('f{{:03d}}', (SELECT count(*) FROM i0) + row_number() OVER (ORDER BY u)), 1, u, c FROM f1",
}

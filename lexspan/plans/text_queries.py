"""Text functions, chunking, ranking and diffs over documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import cache, chunking, diff, logs, ranking
from lexspan.plans._tables import table

_MARKS = ["", "“", "&nbsp;", "‘it’—", "\n\t\t x", "\n\n\n"]
_MARKS_SQL = "['', '“', '&nbsp;', '‘it’—', chr(10) || chr(9) || chr(9) || ' x', chr(10) || chr(10) || chr(10)]"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typographic marks put in, cleaned; hashed."""
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 6 + 1).cast("int"))
    dirty = F.concat(mark, F.coalesce("text", F.lit("")), mark)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.clean_text(dirty)).alias("cleaned"), F.md5(tx.clean_summary_text(F.concat(F.lit("-- "), dirty))).alias("summary"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), chr(160), ' '), '‘', chr(39)), '’', chr(39)), '“', '\"'), '”', '\"'), '—', '--'), chr(10) || chr(9) || '+ *', ' ', 'g'), chr(10) || '+', chr(10), 'g'), '^' || chr(10) || '|' || chr(10) || '$', '', 'g')"
_CLEAN_SQL = f"""WITH d AS (SELECT doc_id, {_MARKS_SQL}[doc_id % 6 + 1] AS m, coalesce(text, '') AS x FROM documents), a AS (SELECT doc_id, m || x || m AS t FROM d), b AS (SELECT doc_id, '-- ' || t AS t FROM a)
SELECT a.doc_id, md5({_CLEAN.replace('(t,', '(a.t,')}) AS cleaned, md5(regexp_replace(regexp_replace({_CLEAN.replace('(t,', '(b.t,')}, '^-+', ''), '^\\s+|\\s+$', '', 'g')) AS summary FROM a JOIN b USING (doc_id)"""


def normalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    shell = F.element_at(F.array(*map(F.lit, ["%s", "The %s", " an  %s ", "the", '**"%s"**', "_%s_", "'%s'", "%s*"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    raw = F.replace(shell, F.lit("%s"), F.col("p_name"))
    return p.select("p_partkey", tx.normalize_term(raw).alias("norm"), tx.normalize_term_loose(raw).alias("loose"), tx.strip_emphasis(raw).alias("bare"), tx.plural_of(F.element_at(F.array(*map(F.lit, ["Annex", "section", "INDEX", "basis"])), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("plural"), tx.strip_sub_prefix(F.concat(F.element_at(F.array(*map(F.lit, ["sub", "Sub-", ""])), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("section"))).alias("base"))


_TERMS_SQL = """WITH r AS (SELECT p_partkey, p_name, replace(['%s', 'The %s', ' an  %s ', 'the', '**"%s"**', '_%s_', '''%s''', '%s*'][p_partkey % 8 + 1], '%s', p_name) AS t FROM part)
SELECT p_partkey, trim(regexp_replace(lower(trim(t)), '^(?:a|an|the)\\s+(.+)$', '\\1')) AS norm, regexp_replace(trim(lower(t)), '^(?:the|an|a) ', '') AS loose,
CASE WHEN p_partkey % 8 IN (4, 5, 6) THEN p_name ELSE trim(t) END AS bare, ['annexes', 'sections', 'indices', 'bases'][p_partkey % 4 + 1] AS plural, 'section' AS base FROM r"""


def fact_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are the same facts."""
    d = table(spark, sf_dir, "documents")
    key = tx.normalize_fact(F.concat(F.lit("  ‘A’ "), F.coalesce("text", F.lit(""))))
    return d.groupBy(F.md5(key).alias("fact")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def near_duplicate_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against its conversation's first: whether it repeats it, case and a final question mark aside."""
    c = table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("primary"))
    extra = F.when(F.col("turn") % 2 == 1, F.concat(tx.upper(F.col("primary")), F.lit("? "))).otherwise(F.col("text"))
    rows = c.join(first, "conv_id").withColumn("asked", extra)
    return rows.select("conv_id", "turn", tx.same_question(F.col("asked"), F.col("primary")).alias("same"))


_SAME_SQL = r"""WITH f AS (SELECT conv_id, min(text) AS primary_text FROM conversations WHERE turn = 0 GROUP BY 1), r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN upper(primary_text) || '? ' ELSE text END AS a, primary_text AS b FROM conversations JOIN f USING (conv_id)),
n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(a), '^\s+|\s+$', '', 'g'), '\?+$', ''), '^\s+|\s+$', '', 'g') AS p, regexp_replace(regexp_replace(regexp_replace(lower(b), '^\s+|\s+$', '', 'g'), '\?+$', ''), '^\s+|\s+$', '', 'g') AS q FROM r),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) AS y FROM n)
SELECT conv_id, turn, contains(q, p) OR contains(p, q) OR (len(p) > 20 AND len(q) > 20 AND len(list_intersect(x, y)) / greatest(len(x), len(y), 1) > 0.75) AS same FROM w"""


def paragraph_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents joined again, with a breakpoint where each begins."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    got = chunking.assemble(lines, ["doc_id"])
    return got.select("doc_id", F.md5("text").alias("body"), F.size("breakpoints").alias("n"), F.coalesce(F.array_max(F.transform("breakpoints", lambda b: b["pos"])), F.lit(0)).alias("last_pos"))


_PARAGRAPH_SQL = "SELECT doc_id, md5(t) AS body, len(a) - 1 AS n, CASE WHEN len(a) > 1 THEN len(t) - len(a[-1]) ELSE 0 END AS last_pos FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)"


def breakpoint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).cast("int").alias("pos"), (F.col("l_suppkey") % 4).cast("int").alias("prio"))
    got = chunking.best_breakpoints(rows, ["l_orderkey"])
    return got.select("l_orderkey", F.array_join(F.transform("breakpoints", lambda b: F.concat_ws(":", b["pos"].cast("string"), b["prio"].cast("string"))), " ").alias("points"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 1,500 characters at most: each ends at the last line
    break within reach, else after the last white space, else at the limit."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    whole = chunking.assemble(lines, ["doc_id"])
    points = F.transform("breakpoints", lambda b: F.struct(b["pos"].alias("pos"), F.lit(1).alias("prio")))
    got = chunking.chunks(whole, F.col("doc_id"), F.col("text"), points, 1500)
    return got.select(F.col("key").cast("long").alias("doc_id"), "seq", "start", "end", F.md5("chunk").alias("chunk"))


_CHUNK_SQL = r"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS seq, 0::BIGINT AS a FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, text, seq + 1, b FROM (SELECT doc_id, text, seq, a + CASE WHEN len(text) - a <= 1500 THEN len(text) - a WHEN regexp_matches(w, '\n') THEN len(regexp_extract(w, '(?s)^(.*\n)', 1)) WHEN regexp_matches(w, '\s') THEN len(regexp_extract(w, '(?s)^(.*\s)', 1)) ELSE 1500 END AS b FROM (SELECT *, substr(text, a + 1, 1500) AS w FROM c)) WHERE b < len(text))
SELECT doc_id, seq, a::INT AS start, e::INT AS "end", md5(substr(text, a + 1, e - a)) AS chunk FROM (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY seq), len(text)) AS e FROM c)"""


def chunk_text_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looser rule, at breakpoints every 700 characters and white space below."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    points = F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / 700).cast("int") + 1), lambda n: F.struct((n * 700).cast("int").alias("pos"), (n % 2 + 1).cast("int").alias("prio")))
    return chunking.chunks(d, F.col("doc_id"), F.col("text"), points, 500, strict=False).select("key", "seq", F.length("chunk").alias("n_chars"))


def signature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.signature(F.col("text"), F.col("lang"), F.lit(None), F.col("source")).alias("signature"))


def diff_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy where every 7th text is longer, every 11th is gone and every 13th new."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = diff.signed(d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    old = diff.signed(d.where("doc_id % 13 <> 0"))
    return diff.compared(new, old, ["doc_id"]).select("doc_id", "change")


def _calls(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(where)
    return cache.with_key(d.select("doc_id", F.col("source").alias("full_cache"), F.col("text").alias("prompt"), F.lit("stub").alias("model"), F.lit(0).alias("max_tokens")))


def cache_union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calls(spark, sf_dir, "true").select("key", F.col("doc_id").alias("file_ord"))
    return cache.first_wins(rows).groupBy().agg(F.count("*").alias("n_entries"), F.sum("file_ord").alias("sum_first"), F.min("key").alias("least_key"))


def cache_miss_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _calls(spark, sf_dir, "doc_id % 3 = 0").select("key", F.lit("answer").alias("response"))
    return cache.misses(_calls(spark, sf_dir, "true"), cache.first_wins(have.withColumn("file_ord", F.lit(0)))).groupBy("full_cache").agg(F.count("*").alias("n_calls"))


_KEY = "sha256(coalesce(source, '') || chr(10) || chr(10) || '---QUERY---' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '---MODEL---' || chr(10) || chr(10) || 'stub' || chr(10) || chr(10) || '---MAX_TOKENS---' || chr(10) || chr(10) || '0')"


def pool_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by their labels, the best ten of each language."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = ranking.clamp(F.col("quality") * 2 + F.col("toxic") * 3)
    scores = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("unit_id"), F.lit("document").alias("type_key"), F.lit(0).alias("doc_id"), F.col("lang").alias("question_id"), score.alias("score"), (F.col("doc_id") % 2).alias("is_external"), F.col("doc_id").alias("ord"))
    units = d.select(F.lit(0).alias("doc_id"), F.lit("document").alias("type_key"), F.col("doc_id").alias("unit_id"), "text", F.lit(None).cast("string").alias("summary_1"), F.lit(0).alias("data_table"))
    return ranking.active_pool(scores, units).where("rank <= 10").select("question_id", "rank", "unit_id", "score")


_POOL_SQL = """SELECT lang AS question_id, rank, doc_id AS unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id % 2, doc_id) AS rank FROM (
SELECT d.*, greatest(0, least(3, coalesce(quality * 2 + toxic * 3, 1))) AS score FROM documents d LEFT JOIN labels USING (doc_id)) WHERE score >= 2 AND text <> '') WHERE rank <= 10"""


def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in batches of ten and 10,000 characters at most: sizes of the batches."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    got = ranking.batches(rows, ["source"], "doc_id", "chars")
    return got.groupBy("source", "batch").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


_BATCH_SQL = """WITH RECURSIVE r AS (SELECT source, doc_id, coalesce(len(text), 0) AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
w AS (SELECT source, doc_id, i, c, 0 AS batch, 1 AS n, c AS s FROM r WHERE i = 1 UNION ALL SELECT r.source, r.doc_id, r.i, r.c, CASE WHEN w.n >= 10 OR w.s + r.c > 10000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 10 OR w.s + r.c > 10000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 10 OR w.s + r.c > 10000 THEN r.c ELSE w.s + r.c END FROM w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, batch, count(*) AS n_docs, sum(c)::BIGINT AS n_chars, min(doc_id) AS first_doc FROM w GROUP BY source, batch"""


def budget_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns of each conversation that fit 1,000 characters."""
    c = table(spark, sf_dir, "conversations")
    return ranking.within_budget(c, ["conv_id"], "turn", F.coalesce(F.length("text"), F.lit(0)), 1000).select("conv_id", "turn")


def close_match_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items most like each other, one pool for all, in whole texts and whatever their case."""
    b = table(spark, sf_dir, "benchmark")
    one = F.lit(0).alias("question_id")
    pool = b.select(one, "item_id", F.upper("text").alias("content"))
    return ranking.neighbours(b.select(one, F.col("item_id").alias("prop_id"), F.col("text").alias("content")), pool).select("prop_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def exhausted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users (questions) that had every event type (unit)."""
    e = table(spark, sf_dir, "events")
    q = e.select(F.col("user_id").alias("question_id"), F.lit("open").alias("status")).distinct()
    seen = e.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("unit_label")).distinct()
    return ranking.exhausted(q, seen, e.select(F.col("event_type").alias("unit_label")))


def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("prompt", F.concat(F.when(F.col("turn") == 0, "extract **defined terms** ").when(F.col("turn") == 1, "trying to find a definition for the term: ").otherwise(""), F.coalesce("text", F.lit(""))))
    got = logs.prompt_lengths(c.withColumn("task", logs.task_of(F.col("prompt"))))
    return got.select("task", "n_calls", F.round("avg_chars", 6).alias("avg_chars"), "max_chars")


_PROMPT_SQL = """SELECT task, count(*) AS n_calls, round(avg(len(p)), 6) AS avg_chars, max(len(p))::INT AS max_chars FROM (SELECT CASE turn WHEN 0 THEN 's2.extract_terms' WHEN 1 THEN 's2.retry_extraction' END AS task,
CASE turn WHEN 0 THEN 'extract **defined terms** ' WHEN 1 THEN 'trying to find a definition for the term: ' ELSE '' END || coalesce(text, '') AS p FROM conversations) GROUP BY task"""


def stage_progress_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    units = d.select("source", F.when(F.col("quality") == 1, "s").alias("summary_1"), F.when(F.col("toxic") == 1, "s").alias("summary_2"), (F.col("lang") == "de").cast("int").alias("data_table"))
    return logs.stage_progress(units, ["source"])


def long_units_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    got = logs.long_units(d, 8000, {"lines": ("\n", 40), "digits": ("[0-9]", 10)})
    return got.select("doc_id", "char_count", F.array_join("patterns", ",").alias("patterns"))


def rejected_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit(" "), F.col("user_id") % 50).alias("text"), F.lit("u").alias("source_unit"), F.when(F.col("event_id") % 2 == 0, " no ").alias("gate_reason"), F.col("event_id").alias("ord"))
    return ranking.rejected_once(e).select("ord")


QUERIES = {
    "clean_text": clean_text, "normalize_terms": normalize_terms, "fact_norm": fact_norm, "near_duplicate_primary": near_duplicate_primary, "paragraph_breakpoints": paragraph_breakpoints, "breakpoint_dedup": breakpoint_dedup,
    "chunk_text": chunk_text, "chunk_text_loose": chunk_text_loose, "signature_hash": signature_hash, "diff_units": diff_units, "cache_union_first_wins": cache_union_first_wins, "cache_miss_antijoin": cache_miss_antijoin,
    "pool_rank_topk": pool_rank_topk, "batch_pack": batch_pack, "budget_tail": budget_tail, "close_match_neighbors": close_match_neighbors, "exhausted_questions": exhausted_questions, "prompt_lengths": prompt_lengths,
    "stage_progress_conditional": stage_progress_conditional, "long_units_patterns": long_units_patterns, "rejected_once": rejected_once,
}
ORACLES = {
    "clean_text": _CLEAN_SQL,
    "normalize_terms": _TERMS_SQL,
    "fact_norm": r"""SELECT md5(lower(regexp_replace(regexp_replace(regexp_replace('  ‘A’ ' || coalesce(text, ''), '[“”‘’`]', '"', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS fact, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1""",
    "near_duplicate_primary": _SAME_SQL,
    "paragraph_breakpoints": _PARAGRAPH_SQL,
    "breakpoint_dedup": "SELECT l_orderkey, string_agg(pos || ':' || prio, ' ' ORDER BY pos) AS points FROM (SELECT l_orderkey, l_partkey % 50 AS pos, min(l_suppkey % 4) AS prio FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "chunk_text": _CHUNK_SQL,
    "signature_hash": "SELECT doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(lang, '') || chr(0) || chr(0) || coalesce(source, '')) AS signature FROM documents",
    "diff_units": "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) AND (doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0)",
    "cache_union_first_wins": f"SELECT count(*) AS n_entries, sum(f)::BIGINT AS sum_first, min(k) AS least_key FROM (SELECT {_KEY} AS k, min(doc_id) AS f FROM documents GROUP BY 1)",
    "cache_miss_antijoin": f"WITH c AS (SELECT *, {_KEY} AS k FROM documents) SELECT source AS full_cache, count(DISTINCT k) AS n_calls FROM c WHERE k NOT IN (SELECT k FROM c WHERE doc_id % 3 = 0) GROUP BY source",
    "pool_rank_topk": _POOL_SQL,
    "batch_pack": _BATCH_SQL,
    "budget_tail": "SELECT conv_id, turn FROM (SELECT *, sum(coalesce(len(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 1000",
    "exhausted_questions": "SELECT user_id AS question_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "prompt_lengths": _PROMPT_SQL,
    "stage_progress_conditional": "SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS with_summary_1, count(*) FILTER (WHERE CASE WHEN lang = 'de' THEN quality = 1 ELSE toxic = 1 END) AS with_summary_2 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "long_units_patterns": "SELECT doc_id, len(text)::INT AS char_count, concat_ws(',', CASE WHEN len(regexp_extract_all(text, chr(10))) >= 40 THEN 'lines' END, CASE WHEN len(regexp_extract_all(text, '[0-9]')) >= 10 THEN 'digits' END) AS patterns FROM documents WHERE len(text) >= 8000",
    "rejected_once": "SELECT min(event_id) AS ord FROM events GROUP BY event_type, user_id % 50, event_id % 2",
}

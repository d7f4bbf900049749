"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontaminate, langid, minhash, ngram_lm, packing, quality_rules, reply_trees, substring, suffix_array
from ._spark import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.conversations(reply_trees.with_parents(table(spark, sf_dir, "conversations")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_spans(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.perplexity(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_reply_trees": op2_reply_trees,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
}

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')"

REPEATED_SPANS_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+{substring.WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM d)),
found AS (SELECT r, i, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY r, i) = 1 THEN 1 ELSE 2 END AS s, count(*) OVER (PARTITION BY k) AS n FROM win),
word AS (SELECT r, p, max(s) AS s FROM (SELECT r, s, unnest(range(i - 1, i + {substring.WINDOW - 1})) AS p FROM found WHERE n > 1) GROUP BY r, p),
run AS (SELECT r, s, p, p - row_number() OVER (PARTITION BY r, s ORDER BY p) AS g FROM word)
SELECT any_value(doc_id) AS doc_id, min(p) AS start_word, max(p) + 1 AS end_word, s = 2 AS removable
FROM run JOIN d USING (r) GROUP BY r, s, g
"""

REPLY_TREES_SQL = """
WITH RECURSIVE base AS (SELECT DISTINCT conv_id, turn, role, text, coalesce(len(text), 0)::BIGINT AS score FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
alt AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, role NULLS FIRST, text NULLS FIRST) - 1 AS alt, max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM base),
m AS MATERIALIZED (SELECT conv_id, turn || '.' || alt AS id, up || '.0' AS parent, score, '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said FROM alt),
p AS (SELECT conv_id, id, 1::BIGINT AS n_turns, score AS path_score, said AS formatted FROM m WHERE parent IS NULL
  UNION ALL SELECT m.conv_id, m.id, p.n_turns + 1, p.path_score + m.score, p.formatted || m.said FROM p JOIN m ON m.conv_id = p.conv_id AND m.parent = p.id)
SELECT conv_id, id AS leaf_id, (row_number() OVER (PARTITION BY conv_id ORDER BY path_score DESC, id))::INT AS branch_rank, n_turns, path_score::BIGINT AS path_score, formatted
FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = p.conv_id AND m.parent = p.id)
"""

NEAR_GROUPS_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, array_to_string(w, ' ') AS t, len(w) AS n, w FROM w WHERE doc_id IS NOT NULL AND len(w) > 0),
u AS MATERIALIZED (SELECT t, min(doc_id) AS rep, count(*) AS n, any_value(w) AS w FROM d GROUP BY t),
s AS MATERIALIZED (SELECT DISTINCT rep, k FROM (SELECT rep, unnest(CASE WHEN len(w) < {minhash.SHINGLE} THEN [t] ELSE list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: array_to_string(w[i:i+{minhash.SHINGLE - 1}], ' ')) END) AS k FROM u)),
c AS MATERIALIZED (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.rep <> y.rep GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE p.n::DOUBLE / (x.n + y.n - p.n) >= {minhash.THRESHOLD}),
r AS (SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS rep, min(b) AS group_id FROM r GROUP BY a)
SELECT doc_id, group_id, doc_id = group_id AS keep FROM (SELECT d.doc_id, g.group_id, count(*) OVER (PARTITION BY g.group_id) AS n FROM d JOIN u USING (t) JOIN g USING (rep)) WHERE n > 1
"""

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {WORDS_SQL} AS w FROM documents),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, len(unnest(w)) AS c FROM d),
{"".join(f"""k{n} AS (SELECT r, i, row_number() OVER (PARTITION BY r, k ORDER BY i) AS o FROM (SELECT r, i, array_to_string(w[i:i+{n - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d))),
c{n} AS (SELECT r, sum(c) AS c FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS p FROM k{n} WHERE o > 1) JOIN word USING (r, p) GROUP BY r),
""" for n in quality_rules.MAX_NGRAM_SHARE)}
line AS (SELECT r, len(t) AS c, row_number() OVER (PARTITION BY r, t) AS o FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM d) WHERE t <> ''),
l AS (SELECT r, sum(c) AS c, sum(CASE WHEN o > 1 THEN c ELSE 0 END) AS dup FROM line GROUP BY r),
t AS (SELECT r, sum(c) AS c FROM word GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, {", ".join(f"coalesce(c{n}.c / t.c, 0)::DOUBLE AS dup_{n}gram_share" for n in quality_rules.MAX_NGRAM_SHARE)}, coalesce(l.dup / l.c, 0)::DOUBLE AS dup_line_share
FROM d LEFT JOIN t USING (r) LEFT JOIN l USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in quality_rules.MAX_NGRAM_SHARE)})
SELECT *, n_words > 0 AND dup_line_share <= {quality_rules.MAX_LINE_SHARE} AND {" AND ".join(f"dup_{n}gram_share <= {x}" for n, x in quality_rules.MAX_NGRAM_SHARE.items())} AS keep FROM m
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": REPEATED_SPANS_SQL,
    "op2_reply_trees": REPLY_TREES_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op5_suffix_array_dedup": REPEATED_SPANS_SQL,
    "op8_minhash_near_dedup": NEAR_GROUPS_SQL,
}

"""Cross-references between documents.

refs:   ref_id, source_doc_id, ref_text, status, ...
corpus: doc_id, file_path, parser_type, stage_reached, org_keys MAP<STRING,
        ARRAY<STRING>>, content_items of the same type, content_scope ARRAY<STRUCT<type,id>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.citations import designator_prefix, parse_citation
from lexspan.functions.text import strip_emphasis
from lexspan.operators.tree import longest_prefix

_STAGE_SUFFIX = "(?:_processed|_stage2_output|_parse_output)$"


def stem(path: F.Column) -> F.Column:
    """File name without directory, suffix and stage."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)(?:\.doc)?(?:\.fmx)?\.[^.]*$", ""), _STAGE_SUFFIX, "")


def folder(path: F.Column) -> F.Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def highest_stage(docs: DataFrame, by_folder: bool = True) -> DataFrame:
    """One row of each document that was registered at several stages: the
    highest stage, then the least doc_id.  by_folder = False takes files
    of one name in different folders for the same document."""
    key = [stem(F.col("file_path"))] + ([folder(F.col("file_path"))] if by_folder else [])
    best = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("stage_reached", F.lit(0))), "doc_id")
    return docs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def parsed(refs: DataFrame) -> DataFrame:
    """ref_id, ref_text and the citation's fields.  The generator evaluates the
    patterns once a row, which a projection on top of another would not."""
    return refs.select("ref_id", "ref_text", F.inline(F.array(parse_citation(F.col("ref_text")))))


_CITED = ["wants", "title", "section", "part"]


def _by_citation(refs: DataFrame) -> DataFrame:
    """parsed() with what is cited as columns without nulls, together by these,
    so that each citation is parsed once and equal ones are looked up once."""
    text = lambda c: F.coalesce(c, F.lit(""))
    cited = [F.when(F.col("usc_title").isNotNull(), "uslm").otherwise("cfr").alias("wants"), text(F.coalesce("usc_title", "cfr_title")).alias("title"), text(F.col("usc_section")).alias("section"), text(F.col("cfr_part")).alias("part")]
    return parsed(refs).select("ref_id", "form", F.coalesce("usc_section", "cfr_section").alias("number"), *cited).repartition(*_CITED)


def _best(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """The best documents of each different citation: _CITED, doc_id, score, tiebreak."""
    cited = cited.where("title <> ''").select(*_CITED).distinct()
    titles = corpus.select("doc_id", "parser_type", F.explode(F.coalesce(F.col("org_keys")["title"], F.array())).alias("title")).distinct()
    met = cited.join(titles, "title").withColumn("right_type", F.col("wants") == F.col("parser_type"))
    sections = corpus.select("doc_id", F.explode(F.coalesce(F.col("content_items")["section"], F.array())).alias("designator")).distinct()
    has = longest_prefix(met.where("section <> ''").select("doc_id", F.col("section").alias("cited")).distinct(), sections, designator_prefix, ["doc_id"]).withColumnRenamed("cited", "section")
    parts = corpus.select("doc_id", F.explode(F.coalesce(F.col("org_keys")["part"], F.array())).alias("part")).distinct().withColumn("has_part", F.lit(True))
    met = met.join(has, ["doc_id", "section"], "left").join(parts, ["doc_id", "part"], "left")
    exact = (F.col("matched") == F.col("section")) | F.coalesce("has_part", F.lit(False))
    base = F.when(F.col("right_type"), 3).otherwise(2)
    score = F.when(F.coalesce(exact, F.lit(False)), F.when(F.col("right_type"), 5).otherwise(3)).when(F.col("matched").isNotNull(), F.when(F.col("right_type"), 4).otherwise(2)).otherwise(base)
    tie = F.coalesce(F.length("matched"), F.when(F.col("has_part"), F.length("part")), F.lit(0))
    best = F.rank().over(Window.partitionBy(*_CITED).orderBy(F.desc("score"), F.desc("tiebreak")))
    return met.select(*_CITED, "doc_id", score.alias("score"), tie.alias("tiebreak")).withColumn("_r", best).where("_r = 1").drop("_r")


def candidates(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best corpus documents for each parsable reference: ref_id, doc_id, score, tiebreak.

    A title of the right parser scores 3, of another 2; a section that is the
    cited one, or covers it, or the cited part, raises that to 5, 4 and 5 (3, 2
    and 3).  Titles are joined by equality, sections by their prefixes."""
    cited = _by_citation(refs)
    return cited.join(_best(cited, corpus), _CITED).select("ref_id", "doc_id", "score", "tiebreak")


def resolve(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Outcome of each reference: resolved by one candidate, ambiguous by
    several, not_in_corpus by none; what can't be parsed stays unresolved."""
    cited = _by_citation(refs)
    best = _best(cited, corpus).groupBy(*_CITED).agg(F.count("*").alias("n_candidates"), F.min("doc_id").alias("least"), F.max("score").alias("score"))
    rows = cited.join(best, _CITED, "left")
    n = F.coalesce("n_candidates", F.lit(0))
    one = n == 1
    status = F.when(F.col("form").isNull(), "unresolved").when(n == 0, "not_in_corpus").when(one, "resolved").otherwise("ambiguous")
    return rows.select("ref_id", status.alias("status"), n.cast("int").alias("n_candidates"), F.coalesce("score", F.lit(0)).alias("score"), F.when(one, F.col("least")).alias("target_doc_id"), F.when(one & F.col("number").isNotNull(), "section").alias("target_item_type"), F.when(one, F.col("number")).alias("target_item_number"))


def retry(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Only what wasn't in the corpus before is tried again."""
    return resolve(refs.where("status = 'not_in_corpus'"), corpus)


def extract_and_resolve(known: DataFrame, found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Incremental run: new references are added, and those open or not in the
    corpus are resolved; settled ones keep their rows."""
    keys = ["source_doc_id", "source_item_type", "source_item_number", "ref_text"]
    new = found.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    every = known.select("ref_id", *keys, "status").unionByName(new.select("ref_id", *keys, F.lit("unresolved").alias("status")))
    open_refs = every.where("status IN ('unresolved', 'not_in_corpus')")
    outcome = resolve(open_refs, corpus).select("ref_id", F.col("status").alias("new_status"), "target_doc_id")
    return every.join(outcome, "ref_id", "left").select("ref_id", *keys, F.coalesce("new_status", "status").alias("status"), "target_doc_id")


def add_references(known: DataFrame, found: DataFrame) -> DataFrame:
    """Insert if absent.  References from definitions (ref_context 'definition') are told apart by
    term too, nulls being equal; others are not."""
    key = [F.col("source_doc_id"), F.col("source_item_type"), F.col("source_item_number"), F.col("ref_text"), F.col("ref_context"), F.when(F.col("ref_context") == "definition", F.col("term"))]
    both = known.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(*key).orderBy("_new", "ref_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1 OR _new = 0").drop("_n", "_new")


def deduplicated(refs: DataFrame, by: list[str]) -> DataFrame:
    """First of each (type, value); needed definitions are compared without emphasis marks."""
    value = F.when(F.col("ref_type") == "Need_Definition", strip_emphasis(F.col("ref_value"))).otherwise(F.col("ref_value"))
    first = Window.partitionBy(*by, "ref_type", value).orderBy("ord")
    return refs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def splits(corpus: DataFrame) -> DataFrame:
    """Parent of each scoped document: the longest scope, of the same parser,
    that properly begins the child's; ties go to the least doc_id.  The scope's
    beginnings are joined by equality."""
    scope = F.transform("content_scope", lambda s: F.concat_ws("=", s["type"], s["id"]))
    rows = corpus.withColumn("scope", scope).where(F.size("scope") > 0)
    starts = F.transform(F.sequence(F.lit(1), F.size("scope") - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("scope", F.lit(1), n), "/").alias("path")))
    child = rows.where(F.size("scope") > 1).select(F.col("doc_id").alias("child_doc_id"), "parser_type", "content_scope", F.explode(starts).alias("s")).select("child_doc_id", "parser_type", "content_scope", "s.n", "s.path")
    parent = rows.groupBy("parser_type", F.array_join("scope", "/").alias("path")).agg(F.min("doc_id").alias("parent_doc_id"))
    met = child.join(parent, ["parser_type", "path"])
    best = met.groupBy("child_doc_id").agg(F.max_by(F.struct("parent_doc_id", F.try_element_at("content_scope", F.col("n") + 1)["type"].alias("split_type")), "n").alias("p"))
    return best.select("p.parent_doc_id", "child_doc_id", "p.split_type")


def split_parents(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents with the parent they were split from, the least if there are several."""
    one = links.groupBy(F.col("child_doc_id").alias("doc_id")).agg(F.min("parent_doc_id").alias("parent_doc_id"))
    return docs.join(one, "doc_id", "left")


def referenced_units(needs: DataFrame, units: DataFrame) -> DataFrame:
    """Summaries of the units that a unit refers to, itself and those without a summary left out."""
    there = units.select("doc_id", F.col("type_key").alias("ref_type"), F.col("unit_id").alias("ref_value"), F.col("unit_path").alias("target_path"), F.col("summary_1"))
    return needs.join(there, ["doc_id", "ref_type", "ref_value"]).where("target_path <> unit_path AND trim(coalesce(summary_1, '')) <> ''")


def type_hint(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs of references and documents whose parser the words of the reference
    suggest; every document where nothing does."""
    t = F.lower("ref_text")
    hints = F.array_compact(F.array(F.when(t.contains("u.s.c") | t.contains("united states code"), "uslm"), F.when(t.contains("c.f.r") | t.contains("regulation"), "cfr"), F.when(t.contains("directive") | t.contains("(eu)"), "formex"), F.when(t.contains("california"), "ca_html")))
    r = refs.select("ref_id", hints.alias("hints"))
    any_type = corpus.select("parser_type").distinct()
    wanted = r.where(F.size("hints") > 0).select("ref_id", F.explode("hints").alias("parser_type")).unionByName(r.where(F.size("hints") == 0).select("ref_id").crossJoin(F.broadcast(any_type)))
    return wanted.join(corpus.select("doc_id", "parser_type"), "parser_type").select("ref_id", "doc_id")

"""Calls to a language model: a protocol, a cache in front of it, and a stub.

A model is anything with ask(context, prompt) -> str.  Each different call is
made once: calls are reduced by their key, misses go to the model in Arrow
batches on the workers, and the answers are checkpointed and joined back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normalize_term
from lexspan.operators import cache
from lexspan.operators.analysis import actions, entries
from lexspan.operators.ranking import clamp, within_budget
from lexspan.operators.state import use_shared_folder
from lexspan.sources.markup import last_json

TRIES = 5


class Model(Protocol):
    def ask(self, context: str, prompt: str) -> str: ...


class Stub:
    """Answers by a hash of the question: a score from 0 to 3, a yes or no, a
    text, two terms, a number from 0 to 7, and actions (a fact, and now and
    then a request for another unit)."""

    def ask(self, context: str, prompt: str) -> str:
        h = hashlib.sha256(f"{context}\x1f{prompt}".encode()).digest()
        text = h.hex()[:12]
        actions = [{"action": "add_entry", "entry": {"type": "fact", "content": text}}] if h[1] % 2 == 0 else []
        if h[2] % 4 == 0:
            actions.append({"action": "request_relevant_section", "target_type": "unit", "target_number": str(h[3] % 32)})
        return json.dumps({"score": h[0] % 4, "verdict": h[1] % 2 == 0, "text": text, "terms": [f"term {x}" for x in text[:2]], "index": h[2] % 8, "actions": actions})


def delays(tries: int = TRIES, base: float = 2.0, jitter: float = 0.1) -> list[float]:
    """Longest waits between tries: each twice the last, with up to a tenth more."""
    return [base * 2**i * (1 + jitter) for i in range(tries - 1)]


def ask_json(model: Model, context: str, prompt: str, keys: list[str], tries: int = TRIES) -> str | None:
    """The answer's last JSON with all keys; the prompt varies a little with each retry; None after the last."""
    for k in range(tries):
        said = last_json(model.ask(context, prompt if k == 0 else f"{prompt}\n(try {k + 1}: answer in JSON)") or "")
        if said is not None and isinstance(obj := json.loads(said), dict) and all(x in obj for x in keys):
            return said
    return None


def answered(calls: DataFrame, known: DataFrame, model: Model, keys: list[str] | None = None, name: str = "stub") -> tuple[DataFrame, DataFrame]:
    """(calls with key and response, cache with the new answers).  calls:
    full_cache, prompt.  A call that stays without a usable answer has null.

    The answers to new calls are checkpointed at once, so that however often
    the results are used, each different call is made once."""
    use_shared_folder(calls.sparkSession)
    calls = cache.with_key(calls.withColumns({"model": F.lit(name), "max_tokens": F.lit(0)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx, prompt = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = [ask_json(model, c or "", p or "", keys) if keys else model.ask(c or "", p or "") for c, p in zip(ctx, prompt)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "response"])

    new = cache.misses(calls, known).select("key", "full_cache", "prompt").mapInArrow(run, "key string, response string").checkpoint()
    full = cache.added(known, new.where("response IS NOT NULL"))
    return cache.answers(calls, full), full


def relevance(units: DataFrame, question: str, known: DataFrame, model: Model) -> DataFrame:
    """Scores 0 to 3 of units(type_key, unit_id, summary); a missing answer scores 1."""
    calls = units.withColumns({"full_cache": F.lit(f"relevance: {question}"), "prompt": F.col("summary")})
    got, _ = answered(calls, known, model, ["score"])
    return got.select("type_key", "unit_id", clamp(F.get_json_object("response", "$.score").cast("int")).alias("score"))


def gated(verdict: Column, kind: str) -> Column:
    """accept, reject or merge; without a verdict facts and questions pass,
    requests don't, and facts close to others are merged."""
    default = {"fact": "accept", "question": "accept", "request": "reject", "close_fact": "merge"}[kind]
    return F.when(verdict.isin("accept", "reject", "merge"), verdict).otherwise(default)


def summaries(units: DataFrame, known: DataFrame, model: Model, blank: str = "No text.") -> DataFrame:
    """First-level summaries; blank texts get a fixed one without a call."""
    has = F.coalesce(F.trim("text"), F.lit("")) != ""
    got, _ = answered(units.where(has).withColumns({"full_cache": F.lit("summarise"), "prompt": F.col("text")}), known, model, ["text"])
    made = got.withColumn("summary_1", F.get_json_object("response", "$.text"))
    return made.select("doc_id", "unit_path", "summary_1").unionByName(units.where(~has).select("doc_id", "unit_path", F.lit(blank).alias("summary_1")))


def chunk_prompt(base: Column, chunk: Column, number: Column, total: Column, before: Column) -> Column:
    """A prompt for one chunk, with what earlier parts said if there are several."""
    several = F.concat(base, F.lit("\n\nPart "), number.cast("string"), F.lit(" of "), total.cast("string"), F.when(before != "", F.concat(F.lit("\nEarlier parts: "), before)).otherwise(F.lit("")), F.lit("\n\n"), chunk)
    return F.when(total <= 1, F.concat(base, F.lit("\n\n"), chunk)).otherwise(several)


def _told(question: str, facts: DataFrame | None, budget: int) -> str:
    """The question, and after it the newest facts that fit the budget of
    characters, oldest first.  A line has a character at least, so no more lines than that can fit."""
    if facts is None:
        return question
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("content"))
    newest = facts.withColumn("line", line).orderBy(F.desc("ord")).limit(budget).withColumn("_all", F.lit(0))
    kept = within_budget(newest, ["_all"], "ord", F.length("line") + 1, budget)
    got = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("t")).first()["t"]
    return f"{question}\n{got}" if got else question


def analyse(units: DataFrame, question: str, model: Model, known: DataFrame, least: int = 2, budget: int = 15_000, waves: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores units(type_key, unit_id, summary), then works through a queue of
    them until it is empty: (scores, facts, asked).

    The units of the best score come first, then those of the next, down to
    `least`; units that answers ask for come as a wave of their own after the
    one that asked, whatever their score, but none twice.  Within a wave units
    are independent.  What a wave finds out is in the context of the next, the
    newest facts first to be kept where not all fit `budget` characters.

    facts: id, ord, wave, unit_id, content, each different content once, as
    f001 and so on in the order of wave and unit.  asked: wave, type_key, unit_id.
    `waves` guards against models that never stop asking."""
    use_shared_folder(units.sparkSession)
    scores = relevance(units, question, known, model).checkpoint()
    scored = units.join(scores, ["type_key", "unit_id"])
    todo = [scored.where(F.col("score") == s) for s in range(3, least - 1, -1)]
    facts: DataFrame | None = None
    asked: DataFrame | None = None
    wave = 0
    while todo and wave < waves:
        now = todo.pop(0).select("type_key", "unit_id", "summary").distinct()
        if asked is not None:
            now = now.join(asked, ["type_key", "unit_id"], "left_anti")
        now = now.checkpoint()
        if now.isEmpty():
            continue
        got, known = answered(now.withColumns({"full_cache": F.lit(_told(question, facts, budget)), "prompt": F.col("summary")}), known, model, ["actions"])
        said = entries(actions(got, ["type_key", "unit_id"]), ["type_key", "unit_id"]).checkpoint()
        here = now.select(F.lit(wave).alias("wave"), "type_key", "unit_id")
        asked = here.checkpoint() if asked is None else asked.unionByName(here).checkpoint()
        new = said.where("kind = 'fact' AND content <> ''").groupBy("content").agg(F.min(F.struct("type_key", "unit_id", "ord")).alias("at"))
        if facts is not None:
            new = new.join(facts.select("content"), "content", "left_anti")
        base = 0 if facts is None else facts.count()
        place = F.row_number().over(Window.orderBy("at")) + base
        new = new.select(place.cast("long").alias("ord"), F.lit(wave).alias("wave"), F.col("at.unit_id").alias("unit_id"), "content").withColumn("id", F.format_string("f%03d", "ord"))
        facts = (new if facts is None else facts.unionByName(new)).checkpoint()
        wanted = said.where("kind = 'request'").select(F.lower(F.split_part("content", F.lit(" "), F.lit(1))).alias("type_key"), F.split_part("content", F.lit(" "), F.lit(2)).alias("unit_id")).distinct()
        more = units.join(wanted, ["type_key", "unit_id"], "left_semi").join(asked, ["type_key", "unit_id"], "left_anti").checkpoint()
        if not more.isEmpty():
            todo.insert(0, more)
        wave += 1
    spark = units.sparkSession
    facts = spark.createDataFrame([], "id string, ord long, wave int, unit_id string, content string") if facts is None else facts.select("id", "ord", "wave", "unit_id", "content")
    asked = spark.createDataFrame([], "wave int, type_key string, unit_id string") if asked is None else asked
    return scores, facts, asked


def final_answer(facts: DataFrame, question: str, model: Model, known: DataFrame, budget: int = 15_000) -> DataFrame:
    """One row: the answer from the facts, and whether the model, asked again
    with it, finds it in order: answer, accepted.  Without facts the answer says so, unasked."""
    use_shared_folder(facts.sparkSession)
    if facts.isEmpty():
        return facts.sparkSession.createDataFrame([("Nothing was found.", False)], "answer string, accepted boolean")
    ask = facts.sparkSession.createDataFrame([(_told(question, facts, budget), "answer")], "full_cache string, prompt string")
    got, _ = answered(ask, known, model, ["text"])
    made = got.select("full_cache", F.get_json_object("response", "$.text").alias("answer"))
    checked, _ = answered(made.withColumn("prompt", F.concat(F.lit("check: "), F.col("answer"))), known, model, ["verdict"])
    return checked.select("answer", (F.get_json_object("response", "$.verdict") == "true").alias("accepted"))


def defined_terms(chunks: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """Terms that chunks(doc_id, unit_path, chunk_no, text) define, each with its
    definition and scope: doc_id, unit_path, term, chunk_no, value, scope.

    Every chunk is asked for its terms; of a unit's chunks the first that names
    a term counts.  Each term then is asked for once more, in that chunk."""
    got, _ = answered(chunks.where("trim(coalesce(text, '')) <> ''").withColumns({"full_cache": F.lit("terms"), "prompt": F.col("text")}), known, model, ["terms"])
    said = got.select("doc_id", "unit_path", "chunk_no", "text", F.posexplode(F.from_json(F.get_json_object("response", "$.terms"), "array<string>")).alias("pos", "term"))
    first = Window.partitionBy("doc_id", "unit_path", normalize_term(F.col("term"))).orderBy("chunk_no", "pos")
    one = said.where("trim(term) <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    told, _ = answered(one.withColumns({"full_cache": F.col("text"), "prompt": F.concat(F.lit("define: "), F.col("term"))}), known, model, ["text"])
    return told.select("doc_id", "unit_path", "term", "chunk_no", F.get_json_object("response", "$.text").alias("value"), F.get_json_object("response", "$.scope").alias("scope"))


def judged_once(definitions: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """definitions(source_path, term, value, ...) with good, asked once for each
    different source, term and value and joined back; blank values are bad, unasked.
    What isn't good is asked for again in the source: improved, null otherwise."""
    key = ["source_path", "term", "value"]
    each = definitions.where("trim(coalesce(value, '')) <> ''").select(*key).distinct()
    got, _ = answered(each.withColumns({"full_cache": F.concat(F.lit("quality of "), F.col("term")), "prompt": F.col("value")}), known, model, ["verdict"])
    good = got.select(*key, (F.get_json_object("response", "$.verdict") == "true").alias("good"))
    bad = good.where("NOT good")
    told, _ = answered(bad.withColumns({"full_cache": F.col("source_path"), "prompt": F.concat(F.lit("improve "), F.col("term"))}), known, model, ["text"])
    improved = told.select(*key, F.get_json_object("response", "$.text").alias("improved"))
    rows = definitions.join(good, key, "left").join(improved, key, "left")
    return rows.withColumn("good", F.coalesce("good", F.lit(False)))


def pairs_judged(pairs: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """pairs(term, one, two) of values that may conflict, with the verdict
    whether the second only elaborates on the first; a pair is asked once, in either order."""
    a, b = F.least("one", "two"), F.greatest("one", "two")
    each = pairs.select("term", a.alias("a"), b.alias("b")).distinct()
    got, _ = answered(each.withColumns({"full_cache": F.col("term"), "prompt": F.concat(F.col("a"), F.lit("\n---\n"), F.col("b"))}), known, model, ["verdict"])
    said = got.select("term", "a", "b", (F.get_json_object("response", "$.verdict") == "true").alias("elaborates"))
    return pairs.withColumns({"a": a, "b": b}).join(said, ["term", "a", "b"], "left").drop("a", "b")


def table_summaries(tables: DataFrame, known: DataFrame, model: Model, most: int = 12_000) -> DataFrame:
    """tables(doc_id, table_key, table_html, row_count, headers) with a summary of
    the structure; without an answer one is made of the counts.  The prompt has the first `most` characters."""
    got, _ = answered(tables.withColumns({"full_cache": F.lit("table structure"), "prompt": F.left(F.coalesce("table_html", F.lit("")), F.lit(most))}), known, model, ["text"])
    fallback = F.concat(F.lit("Table of "), F.col("row_count"), F.lit(" rows"), F.when(F.size("headers") > 0, F.concat(F.lit("; columns: "), F.array_join("headers", ", "))).otherwise(""))
    return got.select("doc_id", "table_key", F.coalesce(F.get_json_object("response", "$.text"), fallback).alias("summary_1"))


def second_summaries(units: DataFrame, context: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """Second-level summaries of units(doc_id, unit_path, text, summary_1), asked
    with their context(doc_id, unit_path, context); blank texts keep the first."""
    rows = units.join(context, ["doc_id", "unit_path"], "left")
    has = F.trim(F.coalesce("text", F.lit(""))) != ""
    got, _ = answered(rows.where(has).withColumns({"full_cache": F.coalesce("context", F.lit("")), "prompt": F.col("text")}), known, model, ["text"])
    made = got.select("doc_id", "unit_path", F.get_json_object("response", "$.text").alias("summary_2"))
    return made.unionByName(rows.where(~has).select("doc_id", "unit_path", F.col("summary_1").alias("summary_2")))


def picked(refs: DataFrame, candidates: DataFrame, known: DataFrame, model: Model, most: int = 200) -> DataFrame:
    """ref_id, doc_id, status of ambiguous refs(ref_id, ref_text): the model is
    given the first `most` candidates(ref_id, doc_id, title), numbered from 0,
    and picks one; no number, or one that stands for none, leaves it ambiguous."""
    n = F.row_number().over(Window.partitionBy("ref_id").orderBy("doc_id")) - 1
    listed = candidates.withColumn("n", n).where(F.col("n") < most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: F.concat(x["n"].cast("string"), F.lit(": "), x["title"])), "\n")
    prompts = listed.groupBy("ref_id").agg(text.alias("prompt")).join(refs.select("ref_id", F.col("ref_text").alias("full_cache")), "ref_id")
    got, _ = answered(prompts, known, model, ["index"])
    choice = got.select("ref_id", F.get_json_object("response", "$.index").cast("int").alias("n"))
    met = choice.join(listed.select("ref_id", "n", "doc_id"), ["ref_id", "n"], "left")
    return met.select("ref_id", "doc_id", F.when(F.col("doc_id").isNotNull(), "resolved").otherwise("ambiguous").alias("status"))


def values_from_targets(wanted: DataFrame, targets: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """Definitions for terms that point elsewhere: wanted(ref_id, doc_id,
    target_path, term) asked in the target's text, targets(doc_id, unit_path, text)."""
    met = wanted.join(targets.select("doc_id", F.col("unit_path").alias("target_path"), "text"), ["doc_id", "target_path"]).where("trim(coalesce(text, '')) <> ''")
    got, _ = answered(met.withColumns({"full_cache": F.col("text"), "prompt": F.concat(F.lit("define: "), F.col("term"))}), known, model, ["text"])
    return got.select("ref_id", F.get_json_object("response", "$.text").alias("value"))


def messages_key(messages: Column, tools: Column, system: Column) -> Column:
    """SHA-256 of a conversation with its tools and system text, as JSON."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), tools.alias("tools"), F.coalesce(system, F.lit("")).alias("system"))), 256)


def lookup_tools(units: DataFrame, definitions: DataFrame, doc_id: object) -> dict[str, Callable[..., str]]:
    """Tools for with_tools(): a unit's text, and a term's definitions, of one document."""
    own, terms = units.where(F.col("doc_id") == doc_id), definitions.where(F.col("doc_id") == doc_id)

    def unit(type_key: str, unit_id: str) -> str:
        got = own.where((F.col("type_key") == type_key) & (F.col("unit_id") == unit_id)).select("text").head(1)
        return got[0]["text"] or "" if got else "There is no such unit."

    def definition(term: str) -> str:
        got = terms.where(normalize_term(F.col("term")) == normalize_term(F.lit(term))).agg(F.array_join(F.array_sort(F.collect_set("value")), "\n").alias("t")).first()["t"]
        return got or "There is no such term."

    return {"unit": unit, "definition": definition}


Callback = Callable[[str, dict], str]


def with_tools(model: Callable[[list[dict]], dict], prompt: str, tools: dict[str, Callable[..., str]], rounds: int = 10) -> str:
    """A loop on the driver: the model answers or names a tool, whose result goes back to it."""
    said: list[dict] = [{"role": "user", "content": prompt}]
    for _ in range(rounds):
        turn = model(said)
        if "tool" not in turn:
            return turn["text"]
        said += [{"role": "assistant", "content": json.dumps(turn)}, {"role": "tool", "content": tools[turn["tool"]](**turn.get("args", {}))}]
    raise RuntimeError("no answer within the rounds")

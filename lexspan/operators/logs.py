"""Reports over logs of model calls: ts, full_cache, prompt, response, cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (task, all of these strings), the first that fits within the prompt's first 800 characters.
TASKS = [
    ("s2.extract_terms", ["extract **defined terms**"]),
    ("s2.extract_definition", ["explicitly created, usable definition** for the term"]),
    ("s2.extract_scope", ["extract the scope of applicability for a definition"]),
    ("s2.evaluate_quality", ["Evaluate whether the following would make sense as a usable definition"]),
    ("s2.evaluate_quality", ["earlier analysis", "was found to be defined as"]),
    ("s2.retry_extraction", ["find a definition for the term:", "trying"]),
]


def task_of(prompt: Column) -> Column:
    head = F.left(prompt, F.lit(800))
    out = None
    for name, needles in TASKS:
        fits = head.contains(needles[0])
        for n in needles[1:]:
            fits &= head.contains(n)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def is_analyst(context: Column, prompt: Column) -> Column:
    whole = F.concat(F.coalesce(context, F.lit("")), F.coalesce(prompt, F.lit("")))
    return whole.contains("Scratch Document") & whole.contains("Your Portion")


def is_compaction(context: Column, prompt: Column) -> Column:
    return F.concat(F.coalesce(context, F.lit("")), F.coalesce(prompt, F.lit(""))).contains("Consolidate them by removing redundant")


def is_implicit_detection(prompt: Column) -> Column:
    return F.coalesce(prompt, F.lit("")).contains("meaningfully referenced")


#: Any of these in a call's context or prompt makes it a relevance call.
_SCORING = ["evaluate the likely relevance", "Please evaluate", "must be one of these four options", "[0] if the portion", "[1] if the portion", "[2] if the portion", "[3] if the portion"]


def is_refinement(prompt: Column) -> Column:
    return F.coalesce(prompt, F.lit("")).contains("REFINEMENT PASS")


def is_scoring(context: Column, prompt: Column, response: Column) -> Column:
    """Asked for a relevance score, or answered with one in brackets."""
    whole = F.concat(F.coalesce(context, F.lit("")), F.coalesce(prompt, F.lit("")))
    out = F.rlike(F.coalesce(response, F.lit("")), F.lit(r"\[[0-3]\]"))
    for x in _SCORING:
        out |= whole.contains(x)
    return out


def prompt_lengths(calls: DataFrame, task: str = "task") -> DataFrame:
    size = F.length("prompt")
    return calls.groupBy(task).agg(F.count("*").alias("n_calls"), F.avg(size).alias("avg_chars"), F.max(size).alias("max_chars"))


def longest(calls: DataFrame, n: int = 10) -> DataFrame:
    return calls.withColumn("chars", F.length("prompt")).orderBy(F.desc("chars"), "ts").limit(n)


def top_with_share(rows: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The n most frequent values with their percentage; of equally frequent ones those seen first."""
    got = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_seen"))
    total = rows.agg(F.count("*").alias("total"))
    return got.crossJoin(F.broadcast(total)).select(key, "n_rows", "first_seen", F.round(100 * F.col("n_rows") / F.col("total"), 2).alias("percent")).orderBy(F.desc("n_rows"), "first_seen").limit(n)


def action_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Actions by kind, from an array of structs with a field `action`."""
    return rows.select(*by, F.explode("actions").alias("a")).groupBy(*by, F.col("a.action").alias("action")).agg(F.count("*").alias("n"))


def stage_progress(units: DataFrame, by: list[str]) -> DataFrame:
    """Units and how many have their summaries; for data tables the first counts as the second too."""
    one = F.coalesce(F.col("summary_1"), F.lit("")) != ""
    two = F.when(F.coalesce(F.col("data_table"), F.lit(0)) == 1, one).otherwise(F.coalesce(F.col("summary_2"), F.lit("")) != "")
    return units.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(one).alias("with_summary_1"), F.count_if(two).alias("with_summary_2"))


def stage_reached(units: DataFrame, by: list[str]) -> DataFrame:
    """3 once a unit has a first summary, 2 once one has defined terms, else 1."""
    some = lambda c: F.bool_or(c)
    return units.groupBy(*by).agg(F.when(some(F.coalesce(F.col("summary_1"), F.lit("")) != ""), 3).when(some(F.coalesce(F.size("defined_terms"), F.lit(0)) > 0), 2).otherwise(1).alias("stage_reached"))


def long_units(units: DataFrame, threshold: int, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """Units of `threshold` characters or more, longest first, with the patterns
    (name: regex, least matches) that they show."""
    found = F.array_compact(F.array(*[F.when(F.regexp_count("text", F.lit(p)) >= n, name) for name, (p, n) in patterns.items()]))
    return units.withColumn("char_count", F.length("text")).where(F.col("char_count") >= threshold).withColumn("patterns", found).orderBy(F.desc("char_count"))

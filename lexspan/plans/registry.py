"""Named queries over the driver's tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspan.plans import definition_queries, markup_queries, more_queries, outline_queries, queue_queries, reference_queries, rule_queries, source_queries, stream_queries, text_queries, tree_queries

_MODULES = (reference_queries, tree_queries, definition_queries, text_queries, queue_queries, source_queries, more_queries, outline_queries, markup_queries, rule_queries, stream_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

"""Logs of model calls: JSON arrays written one after another."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, seq int, ts string, full_cache string, prompt string, response string, cache_created int, cache_read int, cached boolean"
_ARROW = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("ts", pa.string()), ("full_cache", pa.string()), ("prompt", pa.string()), ("response", pa.string()), ("cache_created", pa.int32()), ("cache_read", pa.int32()), ("cached", pa.bool_())])


def entries(text: str, strict: bool = False) -> Iterator[list]:
    """Entries of a log; an array of arrays holds several.  Damage is skipped up
    to the next bracket, or, strict, ends the log."""
    decoder, at = json.JSONDecoder(), 0
    while (m := re.compile(r"\S").search(text, at)) is not None:
        try:
            obj, at = decoder.raw_decode(text, m.start())
        except ValueError:
            if strict:
                return
            at = text.find("[", m.start() + 1)
            if at < 0:
                return
            continue
        if isinstance(obj, list) and obj:
            yield from obj if all(isinstance(x, list) for x in obj) else [obj]


def _fields(e: list) -> tuple:
    if len(e) == 3:  # the older form: prompt parts and response without a time
        return None, e[0], e[1], e[2], None, None, False
    e = [*e, *[None] * (7 - len(e))]
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    number = lambda x: x if isinstance(x, int) else None
    return text(e[0]), text(e[1]), text(e[2]), text(e[3]), number(e[4]), number(e[5]), e[6] == "CACHED"


def calls_of(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each call in files(path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(path, i, *_fields(e)) for i, e in enumerate(entries(content.decode("utf-8", "replace"), strict))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return calls_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), strict)

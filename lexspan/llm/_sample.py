"""Bounded training samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def in_sample(key: Column, share: Column | float) -> Column:
    """True for about that share of the keys; the same keys each time."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_SCALE)) < F.lit(_SCALE) * share


def at_most(rows: DataFrame, key: str, n: int) -> DataFrame:
    """All rows if there are n or fewer, else a hash sample of n on average."""
    total = rows.count()
    return rows.where(in_sample(F.col(key), min(1.0, n / max(1, total))))


def at_most_each(rows: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """The same for each value of group, from one small count by group."""
    shares = {r[0]: min(1.0, n / r[1]) for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not shares:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(group)]
    return rows.where(F.col(group).isNotNull() & in_sample(F.col(key), share))

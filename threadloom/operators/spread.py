"""Joins whose keys may be hot: a few keys are broadcast, the others go by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a join may broadcast at most.
HOT_KEYS = 1 << 14
_LEAST = 1 << 10


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row per key, with ``n`` rows that have it; ``n`` is dropped).

    ``total`` is at least the number of rows. A key of more than a HOT_KEYS-th of them is broadcast, as there are fewer than
    HOT_KEYS such keys, and its rows stay where they are; every other key is a small group.
    """
    least = max(_LEAST, -(-total // HOT_KEYS))
    hot, cold = keyed.where(F.col("n") > least).drop("n"), keyed.where(F.col("n") <= least).drop("n")
    here = rows.join(F.broadcast(hot), key)
    return here.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))

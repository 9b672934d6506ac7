"""Connected components by alternating large-star and small-star steps; everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import join_spread, materialise


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
    return join_spread(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    # a large-star step leaves every edge pointing down
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_spread(edges, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000000007))")).first()
    return tuple(r)


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint, u <> v); root is the smallest node of the component.

    The number of rounds grows with the logarithm of the longest chain; each half round is written to the shared folder.
    The many edges of a star's centre are spread over all tasks (``join_spread``).
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        stars = materialise(_large(now, 2 * seen[0]).distinct())
        now = materialise(_small(stars, 2 * seen[0]))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

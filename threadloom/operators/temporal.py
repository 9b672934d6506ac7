"""Activity over calendar buckets. Mentions without a time fall into the bucket 'unknown'."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import bucket
from threadloom.graph import Graph


def bucketed(g: Graph, days: int = 30) -> DataFrame:
    """bucket, entity_id, n."""
    t = g.of("Message").select(F.col("id").alias("msg_id"), "create_time")
    joined = g.mentions.join(t, "msg_id", "left")
    return joined.groupBy(bucket(F.col("create_time"), days).alias("bucket"), "entity_id").agg(F.count(F.lit(1)).alias("n"))


def top_per_bucket(g: Graph, days: int = 30, top: int = 5) -> DataFrame:
    order = Window.partitionBy("bucket").orderBy(F.desc("n"), "entity_id")
    return bucketed(g, days).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def overall(g: Graph, top: int = 20) -> DataFrame:
    """All mentions of an entity, those without a time included."""
    return g.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(top)


def bucket_activity(g: Graph, days: int = 30) -> DataFrame:
    known = bucketed(g, days).where("bucket <> 'unknown'")
    return known.groupBy("bucket").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("mentions"))


def metrics(g: Graph, days: int = 30) -> DataFrame:
    """entity_id, first, last, total, active_buckets, bursts, cv.

    Mean and deviation are taken over all buckets in which any entity occurs; the squares are summed over the entity's
    active buckets alone; a burst is an active bucket over mean + 2 deviations; with one bucket both are 0.
    """
    b = bucketed(g, days).where("bucket <> 'unknown'")
    buckets = b.agg(F.count_distinct("bucket").alias("k"))
    per = b.groupBy("entity_id").agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("active_buckets")
    )
    with_mean = per.join(F.broadcast(buckets)).withColumn("mean", F.col("total") / F.col("k"))
    spread = b.join(with_mean.select("entity_id", "mean", "k"), "entity_id").groupBy("entity_id").agg(
        F.sqrt(F.sum((F.col("n") - F.col("mean")) * (F.col("n") - F.col("mean"))) / F.max("k")).alias("sd")
    )
    full = with_mean.join(spread, "entity_id")
    over = b.join(full.select("entity_id", "mean", "sd", "k"), "entity_id").where("k > 1 and n > mean + 2 * sd").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("bursts")
    )
    return full.join(over, "entity_id", "left").select(
        "entity_id", "first", "last", "total", "active_buckets", F.coalesce("bursts", F.lit(0)).cast("bigint").alias("bursts"),
        F.when(F.col("k") > 1, F.round(F.col("sd") / F.col("mean"), 4)).otherwise(0.0).alias("cv"),
    )


def bursty(g: Graph, days: int = 30, top: int = 20, least: int = 2) -> DataFrame:
    return metrics(g, days).where((F.col("total") >= least) & (F.col("cv") > 0)).orderBy(F.desc("cv"), "entity_id").limit(top)


def coactivation(g: Graph, days: int = 30, entities: int = 20) -> DataFrame:
    """Pairs among the most mentioned entities by the number of buckets that both occur in, and its share of all buckets."""
    b = bucketed(g, days).where("bucket <> 'unknown'")
    top = b.groupBy("entity_id").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "entity_id").limit(entities).select("entity_id")
    k = b.agg(F.count_distinct("bucket").alias("k"))
    own = b.join(F.broadcast(top), "entity_id", "left_semi").select("bucket", "entity_id")
    a, c = own.select("bucket", F.col("entity_id").alias("a")), own.select("bucket", F.col("entity_id").alias("b"))
    pairs = a.join(c, "bucket").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("buckets"))
    return pairs.join(F.broadcast(k)).select("a", "b", "buckets", F.round(100 * F.col("buckets") / F.col("k"), 2).alias("share"))


def heat(g: Graph, days: int = 30, top: int = 10) -> DataFrame:
    """Counts of the top entities per bucket with the row maximum's share, as for a heat map."""
    b = bucketed(g, days)
    best = overall(g, top).select("entity_id")
    own = b.join(F.broadcast(best), "entity_id", "left_semi")
    return own.select("entity_id", "bucket", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy("entity_id")), 4).alias("share"))


def timeline_wide(g: Graph, days: int = 30, top: int = 5) -> DataFrame:
    """One column per top entity (at most ``top``), one row per bucket."""
    best = [r["entity_id"] for r in overall(g, top).collect()]
    return bucketed(g, days).groupBy("bucket").pivot("entity_id", best).agg(F.sum("n")).fillna(0)


def entity_buckets(g: Graph, name: str = "", days: int = 30, top: int = 20) -> DataFrame:
    """The most mentioned entities of one bucket; no name: of all time."""
    b = bucketed(g, days)
    b = b.where(F.col("bucket") == name) if name else b
    return b.groupBy("entity_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity_id").limit(top)


def pseudo_times(messages: DataFrame) -> DataFrame:
    """Messages without any time get a day each in id order; distributed, by counts per range of ids."""
    from threadloom.plans.ranking import global_rank

    ranked = global_rank(messages, ["id"])
    return ranked.withColumn("create_time", (F.col("rank") - 1) * F.lit(86400.0)).drop("rank")

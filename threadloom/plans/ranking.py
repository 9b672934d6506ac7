"""A global row number without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import durable


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 1) in the order of ``order``: range partitions, ranks inside them, offsets from their counts."""
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn("_k", inside).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")

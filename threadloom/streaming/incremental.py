"""Structured Streaming: an incremental graph build, windowed counts and stream de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.scalars import sha256_hex
from threadloom.graph import MESSAGE, Graph, build, merge


def unprocessed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages whose id has not been processed."""
    return messages.join(processed.select("id"), "id", "left_anti")


def page(messages: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice in the order of ``seq``."""
    out = messages.orderBy("seq").offset(offset)
    return out.limit(limit) if limit is not None else out


def extend(graph: Graph, processed: DataFrame, messages: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with the new messages and the ids processed by then."""
    new = unprocessed(messages, processed)
    return merge(graph, build(new, earlier=processed)), processed.select("id").unionByName(new.select("id")).distinct()


def _last_version(spark: SparkSession, target: str, before: int) -> int | None:
    """The newest whole version under ``target`` of a number below ``before``; empty batches leave gaps."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    names = [x.getPath().getName() for x in store.listStatus(folder)]
    whole = [int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit() and store.exists(folder.suffix(f"/{x}/processed/_SUCCESS"))]
    return max((x for x in whole if x < before), default=None)


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merges every new file of message JSON lines below ``folder`` into the graph at ``target``; each batch is a new version."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        s = batch.sparkSession
        last = _last_version(s, target, number)
        if last is not None:
            old, done = Graph.read(s, f"{target}/v{last}"), s.read.parquet(f"{target}/v{last}/processed")
        else:
            old, done = Graph.empty(s), s.createDataFrame([], "id string")
        new, seen = extend(old, done, batch.select("id", "role", "text", "parent", "create_time", "conversation_id", "lang"))
        new.write(f"{target}/v{number}")
        seen.write.mode("overwrite").parquet(f"{target}/v{number}/processed")

    stream = spark.readStream.schema(MESSAGE).json(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_texts(stream: DataFrame, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """First of every text within the watermark."""
    return stream.withWatermark(time, delay).withColumn("text_hash", sha256_hex(F.col("text"))).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(events: DataFrame, key: str = "event_type", size: str = "1 day", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts per key and tumbling window; works on streams and on tables."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), key, "n")

"""Reply edges on a stream: a child waits in keyed state until its parent arrives, whatever the order.

Each message is sent to the state of its own id, which notes that the id is known, and to the state of its parent's id,
where it waits. All answers to one message would meet in one key, so a parent's state is split into ``spread`` slots: a
child goes to the slot of its hash, the parent to every slot.

Defined results: rows with a null id are left out; a message without a parent makes no edge; a message that names itself
answers itself, as in a batch build; of a repeated row within a batch one counts, in a later batch it makes its edge again
(de-duplicate before); a child whose parent does not come within ``wait`` stays an orphan, and a parent is forgotten when
nobody has answered it for that long. Without ``wait`` nothing is forgotten, and state grows with the messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "parent_id string, child_id string"
SPREAD = 8


def _step(wait_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"parent_id": [], "child_id": []}, dtype="object")
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        known, waiting = state.get if state.exists else (False, [])
        children = set(waiting or [])
        for rows in batches:
            known = known or bool(rows["child"].isna().any())
            children.update(rows["child"].dropna())
        met = sorted(children) if known else []
        state.update((known, [] if known else sorted(children)))
        if wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame({"parent_id": [key[0]] * len(met), "child_id": met}, dtype="object") if met else none

    return step


def reply_edges(messages: DataFrame, wait_ms: int | None = None, spread: int = SPREAD) -> DataFrame:
    """(parent_id, child_id) of a stream of messages (id, parent), each as soon as both of its ends have been seen."""
    slot = F.pmod(F.xxhash64("id"), F.lit(spread))
    nobody = F.lit(None).cast("string").alias("child")
    own = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda k: F.struct(F.col("id").alias("key"), k.cast("bigint").alias("slot"), nobody))
    asks = F.array(F.struct(F.col("parent").alias("key"), slot.alias("slot"), F.col("id").alias("child")))
    sent = F.explode(F.when(F.col("parent").isNull(), own).otherwise(F.concat(own, asks)))
    rows = messages.where("id is not null").select(sent.alias("to")).select("to.*")
    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key", "slot").applyInPandasWithState(_step(wait_ms), EDGES, "known boolean, waiting array<string>", "append", timeout)


def collect_edges(folder: str, source: DataFrame, target: str, checkpoint: str, files: int = 1, spread: int = SPREAD) -> DataFrame:
    """Streams the Parquet files below ``folder`` (of ``source``'s columns), ``files`` a batch, into edges at ``target``.

    It ends with the last file, so nothing waits for a limited time here: with processing-time timeouts Spark plans batches
    without end. Use ``reply_edges`` with ``wait_ms`` in a query that goes on running.
    """
    spark = source.sparkSession
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(folder)
    sink = reply_edges(stream, spread=spread).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EDGES).parquet(target)

"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

Lengths are whole numbers up to the capacity, so the whole plan depends on a histogram of at most ``CAPACITY`` rows: a
proven bound, whatever the number of documents. The plan is made on the driver from those counts:

1. Large-item matching. No three pieces over a third of the capacity fit one bin, so they pair at most twice per bin:
   from the longest down, each takes the longest partner over a third that still fits.
2. The rest, from the longest down, goes where the gap left is smallest (best fit), as many per bin as the gap holds.
   Groups of equal bins are handled as one, so the work grows with the number of lengths and not of documents.

Every piece then finds its place by its rank among the pieces of its length. Ranks come from counts per task and length,
so pieces of one very common length need not meet in one task. Nothing is dropped or capped.

The plan goes to the tasks as groups of equal bins. A length opens at most three groups (two splits and a new one) and a
pair of large lengths two, so there are under 3 x ``CAPACITY`` groups, whatever the number of documents.

Defined results: a null text is empty and gives one piece, the end id alone; a very long text is cut into as many pieces as
it needs; a null doc_id is carried; repeated rows are packed one by one; among pieces of one length the place is settled
by task and position, as any order packs equally well; an empty table gives an empty result; extra columns of the input are
ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.bpe import default_path, encoder
from threadloom.llm.common import materialise, table

CAPACITY = 2048
END_ID = 0


@dataclass
class Bins:
    """``many`` equal bins: items (length, how many of it in each bin) in order, and what is left of each."""

    many: int
    left: int
    items: list[tuple[int, int]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Groups of equal bins that hold all pieces of the histogram (length -> count)."""
    count = {k: n for k, n in histogram.items() if n}
    third = capacity // 3
    bins: list[Bins] = []
    large = sorted(k for k in count if k > third)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a)
        if not at:
            bins.append(Bins(count.pop(a), capacity - a, [(a, 1)]))
            large.pop()
            continue
        b = large[at - 1]
        if a == b:
            pairs = count[a] // 2
            if pairs:
                bins.append(Bins(pairs, capacity - 2 * a, [(a, 2)]))
            count[a] -= 2 * pairs
            if count[a]:
                # the last one looks for a shorter partner
                large.pop()
                b = large[bisect.bisect_right(large, capacity - a) - 1] if large else None
                bins.append(Bins(1, capacity - a - (b or 0), [(a, 1), (b, 1)] if b else [(a, 1)]))
                if b:
                    count[b] -= 1
                    if not count[b]:
                        large.remove(b)
                        del count[b]
            else:
                large.pop()
            count.pop(a)
            continue
        pairs = min(count[a], count[b])
        bins.append(Bins(pairs, capacity - a - b, [(a, 1), (b, 1)]))
        for x in (a, b):
            count[x] -= pairs
            if not count[x]:
                large.remove(x)
                del count[x]
    gaps: dict[int, list[Bins]] = {}
    for g in bins:
        gaps.setdefault(g.left, []).append(g)
    order = sorted(gaps)

    def put(g: Bins) -> None:
        if g.left not in gaps:
            gaps[g.left] = []
            bisect.insort(order, g.left)
        gaps[g.left].append(g)

    for size in sorted((k for k in count if k <= third), reverse=True):
        n = count[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                g = Bins(-(-n // (capacity // size)), capacity, [])
                bins.append(g)
            else:
                gap = order[at]
                g = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            per = g.left // size
            full = min(g.many, n // per)
            if full:
                rest = g.many - full
                if rest:
                    other = Bins(rest, g.left, list(g.items))
                    bins.append(other)
                    put(other)
                    g.many = full
                g.items.append((size, per))
                g.left -= per * size
                n -= full * per
                put(g)
            else:  # one bin takes all that are left
                if g.many > 1:
                    other = Bins(g.many - 1, g.left, list(g.items))
                    bins.append(other)
                    put(other)
                    g.many = 1
                g.items.append((size, n))
                g.left -= n * size
                n = 0
                put(g)
    return bins


class Places:
    """The plan as arrays: from (length, rank) to (sequence, offset)."""

    def __init__(self, bins: list[Bins]) -> None:
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        given: dict[int, int] = {}
        first = 0
        for g in bins:
            offset = 0
            for size, per in g.items:
                start = given.get(size, 0)
                slots.setdefault(size, []).append((start, per, first, offset))
                given[size] = start + per * g.many
                offset += per * size
            first += g.many
        self.slots = {k: np.array(v, dtype=np.int64).T.copy() for k, v in slots.items()}
        self.sequences = first

    def of(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, per, first, offset = self.slots[size]
        k = np.searchsorted(start, ranks, side="right") - 1
        at = ranks - start[k]
        return first[k] + at // per[k], offset[k] + at % per[k] * size


def _cutter(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path or default_path()).ids
        task, given = TaskContext.get().partitionId(), {}
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(ids_of(text) if text else [], dtype="<u4")
                ids = np.append(ids, np.array([END_ID], dtype="<u4"))
                start, n = 0, len(ids)
                end = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    length = end - start
                    rank = given[length] = given.get(length, -1) + 1
                    for c, v in zip(cols, (doc_id, piece, start, length, zlib.crc32(ids[start:end].tobytes()), task, rank)):
                        c.append(v)
                    start, end = end, end + capacity
            kinds = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            )

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces with their rank among the task's pieces of that length; written once."""
    kind = dict(docs.dtypes)["doc_id"]
    return materialise(
        docs.select("doc_id", "text").mapInArrow(
            _cutter(path, capacity),
            f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint",
        )
    )


def _placer(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            sizes, starts = np.unique(length[order], return_index=True)
            for size, part in zip(sizes, np.split(order, starts[1:])):
                sequence[part], offset[part] = places.value.of(int(size), rank[part])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(5)], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of ``docs`` (doc_id, text)."""
    cut = pieces(docs, path, capacity)
    by_task = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # the offsets grow with the number of tasks, so they are joined by key
    ranked = cut.join(offsets.hint("merge"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(
        _placer(places),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; null and empty texts give the end id alone, an empty table no piece."""
    return pack(docs)

"""Searches from many sources of one graph: blocks of sources are dealt over the tasks, and every block gets the edges.

A block receives the edges through a shuffle, packed into arrays; nothing passes the driver. A task holds the edges once, as
two arrays, and a few numbers a vertex for the source at hand, so its memory is bounded where the caller bounds the edges
(``HELD_ENDS``). Larger graphs take the joins of ``large_graphs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of edges that a task may hold: 64 MB as they arrive, as much again while they are sorted.
HELD_ENDS = 1 << 23
#: Vertices that it may have; their names are broadcast where each row of a result needs them.
HELD_VERTICES = 1 << 19
#: Visits of ends by which the number of blocks is chosen, and the most blocks, as each gets all edges.
_VISITS, _MOST_BLOCKS = 1 << 28, 256
_PACK = 1 << 16
_LINK, _WEIGHT, _START = 0, 1, 2


class Held:
    """Neighbours of the vertices 0..n-1: ``near[first[v]:first[v + 1]]``; every vertex has one at least. ``weight``: one number each."""

    def __init__(self, links: np.ndarray, weights: np.ndarray):
        links = np.sort(links)
        self.n, self.near = len(weights), (links & 0xFFFFFFFF).astype(np.int32)
        self.first = np.searchsorted(links >> 32, np.arange(self.n + 1))
        self.weight = np.zeros(self.n)
        self.weight[weights >> 32] = weights & 0xFFFFFFFF

    def gathered(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For every vertex the sum of the ``values`` of those of its neighbours that are among ``at``."""
        count = self.first[at + 1] - self.first[at]
        ends = int(count.sum())
        if ends * 4 < len(self.near):
            places = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(ends)
            return np.bincount(self.near[places], weights=np.repeat(values, count), minlength=self.n)
        x = np.zeros(self.n)
        x[at] = values
        return np.add.reduceat(x[self.near], self.first[:-1])


def levels(g: Held, start: int, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Vertices by distance from ``start`` (up to ``most``), and for each vertex its number of shortest paths."""
    paths, found = np.zeros(g.n), [np.array([start])]
    paths[start] = 1.0
    while most is None or len(found) <= most:
        got = g.gathered(found[-1], paths[found[-1]])
        new = np.flatnonzero((got > 0) & (paths == 0))
        if not len(new):
            break
        paths[new] = got[new]
        found.append(new)
    return found, paths


def _dependencies(g: Held, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(v, x): dependencies on the ``starts``, each as often as the vertices it stands for (see ``large_graphs``)."""
    total = np.zeros(g.n)
    for s in starts:
        found, paths = levels(g, s)
        mass = g.weight.copy()
        for k in range(len(found) - 1, 1, -1):
            at, up = found[k], found[k - 1]
            mass[up] += (g.gathered(at, mass[at] / paths[at]) * paths)[up]
        for at in found[1:]:
            total[at] += g.weight[s] * (mass[at] - 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.n)), pa.array(total)], ["v", "x"])


def _distances(hops: int, least: int) -> Callable[[Held, np.ndarray], Iterator[pa.RecordBatch]]:
    def search(g: Held, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(s, v, distance) of the vertices ``least`` to ``hops`` away."""
        for s in starts:
            found = levels(g, s, hops)[0][least:]
            v = np.concatenate([*found, np.array([], dtype=np.int64)])
            far = np.repeat(np.arange(least, least + len(found), dtype=np.int32), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s)), pa.array(v), pa.array(far)], ["s", "v", "distance"])

    return search


def _counts(hops: int, least: int) -> Callable[[Held, np.ndarray], Iterator[pa.RecordBatch]]:
    def search(g: Held, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(s, n): how many vertices are ``least`` to ``hops`` away."""
        n = [sum(len(x) for x in levels(g, s, hops)[0][least:]) for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array(np.array(n, dtype=np.int64))], ["s", "n"])

    return search


def _packed(rows: DataFrame, kind: int, high: Column, low: Column, n: int) -> DataFrame:
    part = F.pmod(F.xxhash64(high, low), F.lit(max(1, -(-n // _PACK))))
    data = F.collect_list(F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint")))
    return rows.groupBy(part).agg(data.alias("data")).select(F.lit(kind).alias("kind"), "data")


def _search(links: DataFrame, weights: DataFrame, starts: DataFrame, sizes: tuple[int, int, int], kernel: Callable[[Held, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel`` gives for each block of ``starts`` (v); links (a, b) both ways, weights (v, w), all numbered from 0; ``sizes``: their rows."""
    ends, vertices, asked = sizes
    blocks = max(1, min(_MOST_BLOCKS, asked, -(-asked * ends // _VISITS)))
    graph = _packed(links, _LINK, F.col("a"), F.col("b"), ends).unionByName(_packed(weights, _WEIGHT, F.col("v"), F.col("w"), vertices))
    every = graph.crossJoin(F.broadcast(links.sparkSession.range(blocks).select(F.col("id").alias("block"))))
    own = starts.groupBy(F.pmod(F.col("v"), F.lit(blocks)).cast("bigint").alias("block")).agg(F.collect_list(F.col("v").cast("bigint")).alias("data"))
    rows = every.unionByName(own.select(F.lit(_START).alias("kind"), "data", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if parts.get(_START):
                whole = [np.concatenate(parts.pop(k)) for k in (_LINK, _WEIGHT, _START)]
                yield from kernel(Held(whole[0], whole[1]), whole[2])

        for batch in batches:
            for block, kind, data in zip(batch["block"].to_pylist(), batch["kind"].to_pylist(), batch["data"]):
                if block != now:
                    yield from done()
                    now, parts = block, {}
                parts.setdefault(kind, []).append(data.values.to_numpy())
        yield from done()

    return rows.repartition(blocks, "block").sortWithinPartitions("block").select("block", "kind", "data").mapInArrow(run, schema)


def dependencies(links: DataFrame, weights: DataFrame, starts: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """(v, x): summed dependencies on ``starts``."""
    return _search(links, weights, starts, sizes, _dependencies, "v bigint, x double").groupBy("v").agg(F.sum("x").alias("x"))


def distances(links: DataFrame, weights: DataFrame, starts: DataFrame, sizes: tuple[int, int, int], hops: int, least: int) -> DataFrame:
    """(s, v, distance) of all vertices ``least`` (1 or more) to ``hops`` away from each of ``starts``."""
    return _search(links, weights, starts, sizes, _distances(hops, least), "s bigint, v bigint, distance int")


def counts(links: DataFrame, weights: DataFrame, starts: DataFrame, sizes: tuple[int, int, int], hops: int, least: int) -> DataFrame:
    """(s, n): how many vertices are ``least`` to ``hops`` away from each of ``starts``."""
    return _search(links, weights, starts, sizes, _counts(hops, least), "s bigint, n bigint")

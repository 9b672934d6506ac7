"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

1. Vectors are dealt into cells around pivots, fitted on at most some ``FIT`` sampled vectors; every vector goes to the
   nearest pivot of its length. Cells (centre, radius, rows; at most ``CELLS`` and one per length) are the roots of all
   trees and the only table that is broadcast. A cell of more than ``SHARD`` rows is cut into shards by a hash of the id.
2. Queries look at all roots and visit cells in waves: first the cell of the best centre, then the ``NEXT`` best by their
   bound, then all others. After each wave a query's k-th score so far is shared with all its later visits, and cells
   whose bound (centre . q + radius * |q|) is under it are dropped before any vector moves.
3. A wave brings the vectors of each wanted shard and the queries that want it to one task, which builds the shard's ball
   tree once and searches it. A shard that very many queries want is copied, once for every ``VISITORS`` of them.

Inside a tree a node is left out for a query if its bound is under the query's k-th score; children are taken in order of
their bounds. Scores are whole numbers and exact: float64 products while they stay under 2^53, extended precision beyond; a
score that a long cannot hold is clamped.

Defined results: components become floor(256 * x) with x as double. Rows with a null id, a null vector or a null or
non-finite component take no part; an empty vector scores 0. Only vectors of the same length are compared, of any length.
A row is never its own candidate, nor is any repetition of its id; repeated query rows count once per different vector,
repeated candidate rows stay separate candidates. Ties go to the smaller vec_id. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialise, table

CELL = 1024  # rows that a cell aims at, while there are fewer than CELLS
CELLS = 4096
FIT = 32_768
SHARD = 16_384
VISITORS = 16_384
NEXT = 8
LEAF = 64
K = 5
EVERY = 50
_EXACT = 2.0**53
_NONE = -np.iinfo(np.int64).max  # less than any score
_LAST_ID = np.iinfo(np.int64).max


class BallTree:
    """Nodes over rows in tree order; halves are cut at the middle of the widest direction."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.nodes: list[list[int]] = []  # begin, end, left, right
        centres, radii = [], []
        order = np.argsort(ids, kind="stable")
        stack = [(0, len(ids), -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = me
            part = rows[order[begin:end]]
            centre = part.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((part - centre) ** 2).sum(axis=1)).max())
            self.nodes.append([begin, end, -1, -1])
            if end - begin > LEAF and radii[-1] > 0:
                along = part[:, np.argmax(part.var(axis=0))] if rows.shape[1] else ids[order[begin:end]]
                order[begin:end] = order[begin:end][np.argsort(along, kind="stable")]
                half = (begin + end) // 2
                stack += [(half, end, me, 3), (begin, half, me, 2)]
        self.ids, self.rows = ids[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.most = float(np.abs(rows).max(initial=0))

    def search(self, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), queries x k, best first, of rows that score at least ``floor``; ``_NONE`` where there is none."""
        scores, found = np.full((len(q), k), _NONE), np.full((len(q), k), _LAST_ID)
        norms = np.sqrt((q**2).sum(axis=1))
        bounds = q @ self.centres.T + norms[:, None] * self.radii
        bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * self.most) + 1e-6  # rounding must not cut
        bounds[np.isnan(bounds)] = np.inf
        exact = float(np.abs(q).max(initial=0)) * self.most * max(1, q.shape[1]) < _EXACT
        wide, top = (np.float64, 0) if exact else (np.longdouble, np.longdouble(_LAST_ID))
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            who = who[bounds[who, node] >= np.maximum(scores[who, -1], floor[who])]
            if not len(who):
                continue
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                first, second = (left, right) if bounds[who, left].sum() >= bounds[who, right].sum() else (right, left)
                stack += [(second, who), (first, who)]
                continue
            for a in range(begin, end, 1024):  # a ball of equal vectors may be long
                ids = self.ids[a : min(a + 1024, end)]
                got = q[who].astype(wide) @ self.rows[a : a + len(ids)].T.astype(wide)
                got = (got if exact else np.clip(got, -top, top)).astype(np.int64)
                s = np.concatenate([scores[who], np.where(ids == qids[who][:, None], _NONE, got)], axis=1)
                i = np.concatenate([found[who], np.where(ids == qids[who][:, None], _LAST_ID, ids)], axis=1)
                best = np.lexsort((i, -s), axis=1)[:, :k]
                scores[who], found[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        scores[scores < floor[:, None]] = _NONE
        return scores, found


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _away(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances less |row|^2, rows x pivots."""
    return (pivots**2).sum(axis=1) - 2 * rows @ pivots.T


def pivots_of(sample: np.ndarray, many: int, rounds: int = 4) -> np.ndarray:
    """At most ``many`` different centres of a sample, by a few rounds of nearest means."""
    distinct = np.unique(sample, axis=0) if sample.shape[1] else sample[:1]
    centres = distinct[np.linspace(0, len(distinct) - 1, min(many, len(distinct))).astype(int)].copy()
    for _ in range(rounds if len(centres) > 1 else 0):
        near = _away(sample, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        held = count > 0
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[held] = sums[held] / count[held, None]
    return centres


@dataclass
class Roots:
    """Per vector length: numbers, centres, radii and rows of the cells."""

    cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _dealer(pivots):
    """Rows to their cells, with the distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("dim").to_numpy()
            for dim in np.unique(size):
                first, centres = pivots.value[int(dim)]
                part = b.filter(pa.array(size == dim))
                rows = _matrix(part.column("v"), int(dim))
                near = np.concatenate([_away(rows[a : a + 1024], centres).argmin(axis=1) for a in range(0, len(rows), 1024)])
                away = np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array((near + first).astype(np.int32)), part.column("id"), pa.array(away), part.column("v")],
                    ["dim", "cell", "id", "away", "v"],
                )

    return run


def _visitor(roots, wave: int, k: int):
    """Queries to the cells that they visit in this wave, best first, as rows of (cell, query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("dim").to_numpy()
            for dim in np.unique(size):
                if int(dim) not in roots.value.cells:
                    continue
                names, centres, radii, held = roots.value.cells[int(dim)]
                part = b.filter(pa.array(size == dim))
                for a in range(0, part.num_rows, 512):
                    some = part.slice(a, 512)
                    q = _matrix(some.column("v"), int(dim))
                    floor = some.column("floor").fill_null(_NONE).to_numpy(zero_copy_only=False)
                    inner, slack = q @ centres.T, np.sqrt((q**2).sum(axis=1))[:, None] * radii
                    bounds = inner + slack
                    bounds = bounds + 1e-9 * (np.abs(inner) + np.abs(slack)) + 1e-6  # rounding must not cut
                    bounds[np.isnan(bounds)] = np.inf
                    order = np.argsort(-(inner if wave == 0 else bounds), axis=1, kind="stable")
                    if wave == 0:  # enough cells for k candidates besides the query itself
                        before = np.cumsum(held[order], axis=1) - held[order]
                        go = np.zeros(order.shape, dtype=bool)
                        np.put_along_axis(go, order, before <= k, axis=1)
                    else:
                        go = bounds >= floor[:, None]
                        seen = some.column("seen").to_pylist()
                        at = {c: i for i, c in enumerate(names.tolist())}
                        for i, cells in enumerate(seen):
                            go[i, [at[c] for c in cells]] = False
                        if wave == 1:
                            rank = np.cumsum(np.take_along_axis(go, order, axis=1), axis=1)
                            best = np.zeros(order.shape, dtype=bool)
                            np.put_along_axis(best, order, rank <= NEXT, axis=1)
                            go &= best
                    who, cell = np.nonzero(go)
                    rows = some.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[cell]), rows.column("id"), rows.column("q"), pa.array(floor[who]), rows.column("v")],
                        ["cell", "id", "q", "floor", "v"],
                    )

    return run


def _searcher(k: int):
    """Rows sorted by shard, its vectors before its queries, to the queries' hits in that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, tree = None, [], [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "shard", "part", "kind")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for a, z in zip(cuts, np.r_[cuts[1:], len(key)]):
                part, shard = b.slice(a, z - a), tuple(key[a, :3])
                v = part.column("v")
                v = _matrix(v, len(v[0]))
                if shard != at:
                    at, ids, rows, tree = shard, [], [], None
                if key[a, 3] == 0:
                    ids.append(part.column("id").to_numpy())
                    rows.append(v)
                    continue
                if not ids:
                    continue
                if tree is None:  # built once per shard and task
                    tree = BallTree(np.concatenate(ids), np.concatenate(rows))
                qids, floor = part.column("id").to_numpy(), part.column("floor").to_numpy()
                for c in range(0, len(qids), 512):
                    scores, found = tree.search(qids[c : c + 512], v[c : c + 512], floor[c : c + 512], k)
                    real = scores != _NONE
                    many = real.sum(axis=1)
                    cols = [np.repeat(qids[c : c + 512], many), np.repeat(part.column("q").to_numpy()[c : c + 512], many), found[real], scores[real]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "q", "vec_id", "score"])

    return run


def _dealt(vectors: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(dim, cell, id, away, v) for all vectors, (dim, cell, n, radius) per cell, and per length (first cell, pivots)."""
    spark = vectors.sparkSession
    rows = _usable(vectors)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    total = max(1, sum(sizes.values()))
    place = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "v"), 11) + 1) / F.lit(float(1 << 53))
    some = rows.where(place <= F.lit(FIT / 2 / total)).select("dim", "v").distinct().limit(FIT).collect() if sizes else []
    pivots, first = {}, 0
    for dim, n in sorted(sizes.items()):
        mine = [r["v"] for r in some if r["dim"] == dim]
        sample = np.array(mine, dtype=np.float64).reshape(len(mine), dim)
        many = max(1, min(n // CELL, CELLS * n // total))
        centres = pivots_of(sample, many) if len(sample) else np.zeros((1, dim))
        pivots[dim] = (first, centres)
        first += len(centres)
    sent = spark.sparkContext.broadcast(pivots)
    dealt = materialise(rows.mapInArrow(_dealer(sent), "dim int, cell int, id bigint, away double, v array<double>"))
    return dealt, dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")), pivots


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _waves(vectors: DataFrame, queries: DataFrame, k: int, shard: int, visitors: int) -> tuple[DataFrame, list[DataFrame], int]:
    """Hits of all waves (k best per query), the visits of each wave, and the number of cells."""
    spark = vectors.sparkSession
    dealt, cells, pivots = _dealt(vectors)
    known, roots = cells.collect(), {}  # at most CELLS and one per length
    for dim, (first, centres) in pivots.items():
        mine = sorted((r["cell"], r["n"], r["radius"]) for r in known if r["dim"] == dim)
        names = np.array([c for c, _, _ in mine], dtype=np.int32)
        roots[dim] = (names, centres[names - first], np.array([r for _, _, r in mine]), np.array([n for _, n, _ in mine]))
    sent = spark.sparkContext.broadcast(Roots(roots))
    shards = F.broadcast(spark.createDataFrame([(r["cell"], -(-r["n"] // shard)) for r in known], "cell int, shards int"))
    split = dealt.join(shards, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "id", "v")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = materialise(_usable(queries).distinct().withColumn("q", F.xxhash64("v")))
    state = asked.withColumn("floor", F.lit(None).cast("bigint")).withColumn("seen", F.array().cast("array<int>"))
    hits, visits = None, []
    for wave in range(3):
        pairs = materialise(state.mapInArrow(_visitor(sent, wave, k), "cell int, id bigint, q bigint, floor bigint, v array<double>"))
        visits.append(pairs)
        parts = F.broadcast(pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(visitors)).cast("int").alias("parts")))  # at most as many as cells
        nothing = F.lit(None).cast("bigint")
        there = split.join(parts, "cell").select(
            "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", nothing.alias("q"), nothing.alias("floor"), "v"
        )
        come = pairs.join(parts, "cell").join(shards, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("q", "id"), F.col("parts")).cast("int").alias("part"),
            F.lit(1).alias("kind"), "id", "q", "floor", "v",
        )
        met = there.unionByName(come).repartition(n, "cell", "shard", "part").sortWithinPartitions("cell", "shard", "part", "kind")
        found = met.mapInArrow(_searcher(k), "query_id bigint, q bigint, vec_id bigint, score bigint")
        hits = materialise(_best(found if hits is None else hits.drop("rank").unionByName(found), k))
        if wave < 2:
            floors = hits.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "q", F.col("score").alias("floor"))
            gone = pairs.groupBy("id", "q").agg(F.collect_list("cell").alias("cells"))  # bounded by the number of cells
            state = (
                state.drop("floor").join(floors, ["id", "q"], "left").join(gone, ["id", "q"], "left")
                .withColumn("seen", F.concat("seen", F.coalesce("cells", F.array().cast("array<int>")))).drop("cells")
            )
            state = materialise(state.select("dim", "id", "v", "q", "floor", "seen"))
    return hits, visits, len(known)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, visitors: int = VISITORS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) for every row of ``queries``."""
    hits, _, _ = _waves(vectors, queries, k, shard, visitors)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_counts(vectors: DataFrame, queries: DataFrame, k: int = K) -> list[tuple[int, int]]:
    """Per wave (visits of a query to a cell, visits that there would be without bounds)."""
    _, visits, cells = _waves(vectors, queries, k, SHARD, VISITORS)
    every = _usable(queries).distinct().count() * cells
    return [(v.count(), every) for v in visits]


def _usable(vectors: DataFrame) -> DataFrame:
    """dim, id and whole-number components ``v`` of the rows that take part."""
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    known = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(real)
    # floor() gives a long; large values need a double, and -0.0 must equal 0.0
    whole = F.transform("v", lambda x: F.when(F.abs(x) < F.lit(float(1 << 50)), F.floor(x * 256).cast("double")).otherwise(x * 256))
    return known.select(F.size("v").alias("dim"), "id", whole.alias("v"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector, by whole-number inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: DuckDB: every query against every row.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e from embeddings
  where vec_id is not null and embedding is not null and list_aggregate(list_transform(embedding, lambda x: (x is not null and isfinite(x))::int), 'min') = 1),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5
"""

"""Embeddings from incidence, walks and vectors; cosine neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import cosine, dot, norm
from threadloom.graph import Graph

RANK_CAP = 64


def incidence(g: Graph, keywords: bool = False) -> DataFrame:
    """(row, col): messages with an entity by entity, with keywords beside if asked; every value is 1."""
    ents = g.mentions.select(F.col("msg_id").alias("row"), F.col("entity_id").alias("col"))
    if not keywords:
        return ents.distinct()
    keys = g.keywords.join(g.mentions.select("msg_id").distinct(), "msg_id", "left_semi")
    return ents.unionByName(keys.select(F.col("msg_id").alias("row"), F.col("keyword_id").alias("col"))).distinct()


def svd(cells: DataFrame, dim: int = 32, rounds: int = 5, seed: int = 42, scaled: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((row, vector), singular values) of a sparse (row, col[, value]) matrix by randomised subspace iteration.

    Both sides of the product stay DataFrames; only (dim + 8)^2 numbers come to the driver, to make each side orthonormal
    between two products. A round is two joins with pre-aggregated sums. ``scaled`` gives U * S instead of U.
    """
    spark = cells.sparkSession
    value = F.col("value") if "value" in cells.columns else F.lit(1.0)
    m = cells.select("row", "col", value.cast("double").alias("value")).cache()
    n_rows, n_cols = m.select("row").distinct().count(), m.select("col").distinct().count()
    k = max(0, min(dim, min(n_rows, n_cols) - 1, RANK_CAP))
    if k < 1:
        return spark.createDataFrame([], "row string, vector array<double>"), np.zeros(0)
    wide = min(k + 8, min(n_rows, n_cols))
    gauss = F.array(*[_noise("col", seed + i) for i in range(wide)])
    basis = m.select("col").distinct().select("col", gauss.alias("q"))

    def times(left: DataFrame, by: str, to: str) -> DataFrame:
        sums = [F.sum(F.get("q", F.lit(i)) * F.col("value")).alias(f"x{i}") for i in range(wide)]
        return m.join(left, by).groupBy(to).agg(*sums).select(to, F.array(*[f"x{i}" for i in range(wide)]).alias("q"))

    def gram(df: DataFrame, width: int) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                q = batch.column("q").flatten().to_numpy().reshape(-1, width)
                total += q.T @ q
            yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["i", "x"])

        sums = df.select("q").mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(width * width)
        for r in sums:
            out[r["i"]] = r["x"]
        return out.reshape(width, width)

    def apply(df: DataFrame, key: str, r: np.ndarray) -> DataFrame:
        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = batch.column("q").flatten().to_numpy().reshape(-1, r.shape[0]) @ r
                ends = pa.array(np.arange(len(q) + 1) * r.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(q.ravel()))], [key, "q"])

        return df.select(key, "q").mapInArrow(turned, f"{key} {dict(df.dtypes)[key]}, q array<double>")

    def orthonormal(df: DataFrame, key: str) -> DataFrame:
        vals, vecs = np.linalg.eigh(gram(df, wide))
        keep = vals > max(vals.max(), 0) * 1e-12
        inv = vecs * np.where(keep, 1 / np.sqrt(np.where(keep, vals, 1)), 0)
        return apply(df, key, inv)

    from threadloom.session import durable

    for _ in range(rounds):
        left = orthonormal(durable(times(basis, "col", "row")), "row")
        basis = durable(orthonormal(durable(times(left, "row", "col")), "col"))
    u = durable(times(basis, "col", "row"))
    vals, vecs = np.linalg.eigh(gram(u, wide))
    order = np.argsort(-vals)[:k]
    sigma = np.sqrt(np.maximum(vals[order], 0))
    turn = vecs[:, order] / (1 if scaled else np.where(sigma > 1e-9, sigma, np.inf))
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    m.unpersist()
    return apply(u, "row", turn).select("row", F.col("q").alias("vector")), sigma


def _noise(key: str, seed: int):
    """A number in (-1, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1


def mean_vectors(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def nearest(vectors: DataFrame, ident: str | int, key: str = "id", vector: str = "vector", top: int = 10, least: float = -1.0) -> DataFrame:
    """(key, cosine) of the ``top`` vectors nearest to one; the one is left out; a zero vector has no neighbours."""
    q = vectors.where(F.col(key) == ident).select(F.col(vector).alias("_q")).limit(1)
    others = vectors.where(F.col(key) != ident).join(F.broadcast(q))  # one row
    scored = others.where(norm(F.col("_q")) > 0).select(key, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("cosine"))
    return scored.where(F.col("cosine") >= least).orderBy(F.desc("cosine"), key).limit(top)


def spectral(g: Graph, dim: int = 32, keywords: bool = False) -> DataFrame:
    """(id, vector) of messages and, mean-pooled, of conversations."""
    u, _ = svd(incidence(g, keywords), dim)
    msgs = u.select(F.col("row").alias("id"), "vector")
    convs = mean_vectors(msgs.join(g.contains, F.col("id") == F.col("msg_id")).select("conv_id", "vector"), "conv_id")
    return msgs.unionByName(convs.select(F.col("conv_id").alias("id"), "vector"))


def walk_pairs(walks: DataFrame, window: int = 5) -> DataFrame:
    """(row, col, value): how often two vertices lie within ``window`` places on a walk."""
    a, b = walks.select("walk", F.col("place").alias("pa"), F.col("id").alias("row")), walks.select("walk", F.col("place").alias("pb"), F.col("id").alias("col"))
    near = a.join(b, "walk").where((F.col("pb") != F.col("pa")) & (F.abs(F.col("pb") - F.col("pa")) <= window))
    return near.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("value"))


def explained_variance(sigma: np.ndarray, cells: DataFrame) -> float:
    """Share of the squared norm of a 0/1 incidence that the singular values hold."""
    total = cells.count()
    return float((sigma**2).sum() / total) if total else 0.0


__all__ = ["dot", "explained_variance", "incidence", "mean_vectors", "nearest", "spectral", "svd", "walk_pairs"]

"""Centrality, communities, bridges and random walks of the co-occurrence graph, by joins (``large_graphs``) at every size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.graph import Graph
from threadloom.operators import source_blocks
from threadloom.operators.large_graphs import betweenness, both_ways, leiden, numbered, numbered_links, walks_by_steps
from threadloom.operators.spread import spread_join
from threadloom.operators.traversal import components
from threadloom.session import durable


def cooc_edges(g: Graph, least: int = 1) -> DataFrame:
    return g.cooc.where(F.col("weight") >= least).select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), "weight")


def entity_centrality(g: Graph, top: int = 20, least: int = 2, largest: bool = False) -> DataFrame:
    """id, betweenness, degree of the most central entities; ``largest``: in the largest component alone."""
    e = cooc_edges(g, least)
    if largest:
        comp = components(e.select("a", "b"))
        size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
        keep = comp.join(F.broadcast(size), "component").select(F.col("id").alias("a"))
        e = e.join(keep, "a", "left_semi")
    ends = e.select(F.col("a").alias("id")).unionAll(e.select(F.col("b").alias("id")))
    deg = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return betweenness(e.select("a", "b")).join(deg, "id").orderBy(F.desc("betweenness"), F.desc("degree"), "id").limit(top)


def communities(g: Graph, least: int = 2, min_size: int = 3) -> DataFrame:
    """(id, component, community): communities inside every component of ``min_size`` vertices or more, each connected and
    named by its smallest id; the largest components are spread over all tasks."""
    e = durable(cooc_edges(g, least))
    comp = durable(components(e.select("a", "b")))
    size = durable(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size))
    member = spread_join(comp, size, "component", comp.count()).select(F.col("id").alias("a"), "component")
    return leiden(e.join(member, "a").select("component", "a", "b", "weight"))


def inner_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (a, b, weight) whose ends lie in one part of (id, community), with that ``community``."""
    left = parts.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    right = parts.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    return edges.join(left, "a").join(right, "b").where("ca = cb").select("a", "b", "weight", F.col("ca").alias("community"))


def partition_modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(vertices, communities, modularity): one row for parts (id, community) of weighted edges (a, b, weight), by sums alone.

    Edges with an end outside the parts count for neither; without edges the modularity is 0.
    """
    ends = parts.select("id", "community")
    known = edges.join(ends.select(F.col("id").alias("a")), "a", "left_semi").join(ends.select(F.col("id").alias("b")), "b", "left_semi")
    total = known.agg(F.sum("weight").cast("double").alias("t"))
    inside = inner_edges(known, ends).groupBy("community").agg(F.sum("weight").cast("double").alias("inside"))
    strength = known.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").cast("double").alias("s"))
    per = ends.join(strength, "id", "left").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("s", F.lit(0.0))).alias("s"))
    part = F.coalesce("inside", F.lit(0.0)) / F.col("t") - F.pow(F.col("s") / (2 * F.col("t")), 2)
    return per.join(inside, "community", "left").join(F.broadcast(total)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.count(F.lit(1)).alias("communities"), F.coalesce(F.round(F.sum(part), 6), F.lit(0.0)).alias("modularity")
    )


def topic_clusters(g: Graph, least: int = 2, min_size: int = 3, top: int = 10) -> DataFrame:
    """community, size, edges inside, top entities by degree and top keywords of each cluster."""
    comm = communities(g, least, min_size)
    size = comm.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    e = cooc_edges(g, least)
    inside = inner_edges(e, comm)
    edges = inside.groupBy("community").agg(F.count(F.lit(1)).alias("edges"))
    ends = inside.select(F.col("a").alias("id"), "community").unionAll(inside.select("b", "community"))
    deg = ends.groupBy("id", "community").agg(F.count(F.lit(1)).alias("degree"))
    order = Window.partitionBy("community")

    def best(df: DataFrame, score: str, key: str, alias: str, k: int) -> DataFrame:
        r = df.withColumn("r", F.row_number().over(order.orderBy(F.desc(score), key))).where(F.col("r") <= k)
        return r.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", key))), lambda x: x[key]), ", ").alias(alias))

    msgs = comm.join(g.mentions, F.col("id") == F.col("entity_id")).select("community", "msg_id").distinct()
    kw = msgs.join(g.keywords, "msg_id").groupBy("community", "keyword_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        size.join(edges, "community", "left").join(best(deg, "degree", "id", "entities", 10), "community", "left")
        .join(best(kw, "n", "keyword_id", "keywords", 5), "community", "left").orderBy(F.desc("size"), "community").limit(top)
    )


def entity_domains(g: Graph, least: int = 2) -> DataFrame:
    """(id, domain): the first three member names of an entity's community."""
    comm = communities(g, least, 2).join(g.names.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", "id"))
    r = comm.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where("r <= 3")
    named = r.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("domain"))
    return comm.join(named, "community").select("id", "domain")


def shortest_paths(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, target, distance) up to ``hops`` over undirected (a, b); one join per hop, visited pairs are not extended."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    seen = durable(sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0).alias("distance")))
    front = seen
    for k in range(1, hops + 1):
        step = front.join(both, front["target"] == both["a"]).select("source", F.col("b").alias("target")).distinct()
        front = durable(step.join(seen, ["source", "target"], "left_anti").select("source", "target", F.lit(k).alias("distance")))
        seen = seen.unionByName(front)
    return seen


def _scored(g: Graph, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) and (id, betweenness)."""
    e = durable(cooc_edges(g, least).select("a", "b"))
    return e, durable(betweenness(e))


def _held(e: DataFrame, b: DataFrame, starts: DataFrame, held: int):
    """Links, weights, starts and sizes for ``source_blocks``, and the numbered ids; None if the graph is too large for a task."""
    links = durable(both_ways(e.where("a <> b")).distinct())
    ends, vertices = links.count(), b.count()
    if not ends or ends > held or vertices > source_blocks.HELD_VERTICES:
        return None
    ids = numbered(b.join(links.select(F.col("a").alias("id")), "id", "left_semi"))
    own = ids.join(starts.select("id"), "id", "left_semi").select("v")
    return (numbered_links(links, ids), ids.select("v", F.lit(1).alias("w")), own, (ends, vertices, vertices)), ids


def _bridges(b: DataFrame, far: DataFrame) -> DataFrame:
    x, y = b.select(F.col("id").alias("source"), F.col("betweenness").alias("bs")), b.select(F.col("id").alias("target"), F.col("betweenness").alias("bt"))
    return far.join(x, "source").join(y, "target").select(
        F.col("source").alias("entity_a"), F.col("target").alias("entity_b"), F.col("distance").alias("path_length"), F.round((F.col("bs") + F.col("bt")) / 2, 6).alias("betweenness")
    )


def entity_bridges(g: Graph, least: int = 2, max_path: int = 4, min_betweenness: float = 0.01, held: int = source_blocks.HELD_ENDS) -> DataFrame:
    """entity_a, entity_b, path_length, betweenness: from every bridge to targets 2..max_path hops away; mean of both ends.

    The rows are nearly all pairs of a graph of short ways. Where a task may hold the edges, each row is made once and stored
    nowhere on its way.
    """
    e, b = _scored(g, least)
    starts = b.where(F.col("betweenness") >= min_betweenness)
    known = _held(e, b, starts, held)
    if known is None:
        return _bridges(b, shortest_paths(e, starts, max_path).where("distance >= 2"))
    graph, ids = known
    # names of at most HELD_VERTICES
    x, y = F.broadcast(ids.select(F.col("v").alias("s"), F.col("id").alias("entity_a"), F.col("betweenness").alias("bs"))), F.broadcast(ids.select("v", F.col("id").alias("entity_b"), F.col("betweenness").alias("bt")))
    far = source_blocks.distances(*graph, max_path, 2)
    return far.join(x, "s").join(y, "v").select("entity_a", "entity_b", F.col("distance").alias("path_length"), F.round((F.col("bs") + F.col("bt")) / 2, 6).alias("betweenness"))


def count_bridges(g: Graph, least: int = 2, max_path: int = 4, min_betweenness: float = 0.01, held: int = source_blocks.HELD_ENDS) -> DataFrame:
    """(n): how many rows ``entity_bridges`` has, without making them."""
    e, b = _scored(g, least)
    starts = b.where(F.col("betweenness") >= min_betweenness)
    known = _held(e, b, starts, held)
    if known is None:
        return shortest_paths(e, starts, max_path).where("distance >= 2").agg(F.count(F.lit(1)).alias("n"))
    return source_blocks.counts(*known[0], max_path, 2).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def bridges_by_source(g: Graph, least: int = 2, max_path: int = 4, min_betweenness: float = 0.01) -> Callable[[DataFrame], DataFrame]:
    """The rows of ``entity_bridges`` for given ids (id) alone: betweenness is worked out once, ways on each call."""
    e, b = _scored(g, least)

    def of(ids: DataFrame) -> DataFrame:
        starts = b.where(F.col("betweenness") >= min_betweenness).join(ids.select("id"), "id", "left_semi")
        return _bridges(b, shortest_paths(e, starts, max_path).where("distance >= 2"))

    return of


def first_bridges(g: Graph, least: int = 2, max_path: int = 4, min_betweenness: float = 0.01, batch: int = 16) -> DataFrame:
    """The rows of ``entity_bridges`` for the smallest entity_a that has any; candidates are looked at in their order, a growing batch at a time."""
    e, b = _scored(g, least)
    left = b.where(F.col("betweenness") >= min_betweenness).select("id")
    while True:
        now = durable(left.orderBy("id").limit(batch))
        found = durable(_bridges(b, shortest_paths(e, now, max_path).where("distance >= 2")))
        last, first = now.agg(F.max("id")).first()[0], found.agg(F.min("entity_a")).first()[0]
        if first is not None or last is None:
            return found.where(F.col("entity_a") == first)
        left, batch = left.where(F.col("id") > last), batch * 4


def bridges_of(bridges: DataFrame, entity_id: str, top: int = 20) -> DataFrame:
    return bridges.where(F.col("entity_a") == entity_id).orderBy(F.desc("betweenness"), "entity_b").limit(top)


def prune(edges: DataFrame, most: int = 100) -> DataFrame:
    """The strongest ``most`` edges of each end; an edge stays if one of its ends keeps it."""
    ends = edges.select(F.col("a").alias("v"), "a", "b", "weight").unionAll(edges.select(F.col("b").alias("v"), "a", "b", "weight"))
    r = ends.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("weight"), "a", "b")))
    return r.where(F.col("r") <= most).select("a", "b", "weight").distinct()


def random_walks(g: Graph, length: int = 40, walks: int = 10, p: float = 1.0, q: float = 1.0, least: int = 2, seed: int = 42) -> DataFrame:
    """(walk, place, id): biased walks over the pruned co-occurrence graph; each start's walks depend on the seed alone."""
    return walks_by_steps(durable(prune(cooc_edges(g, least))), length, walks, seed, p, q)

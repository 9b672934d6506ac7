"""Betweenness, communities and walks as joins, for graphs of any size.

Edges are undirected (a, b[, weight]). Every step is a keyed join or a grouped sum; rounds are written to the checkpoint
folder. Nothing but counts and sums comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import source_blocks
from threadloom.operators.spread import spread_join
from threadloom.operators.traversal import components
from threadloom.session import durable, release

#: Rows (source, vertex) that one wave of sources may hold; more sources than fit take more waves.
WAVE_ROWS = 2_000_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends, further columns kept."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *rest).unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def sources_for(vertices: int, error: float, failure: float = 0.05) -> int:
    """Sources that sampled betweenness takes so that, with probability 1 - ``failure``, every vertex of a graph of so many
    vertices is off by at most ``error`` * vertices * (vertices - 2) / 2: Hoeffding's bound on dependencies, for all vertices at once."""
    return min(vertices, math.ceil(math.log(2 * max(1, vertices) / failure) / (2 * error * error)))


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a number ``v`` from 0, in the order of their ids."""
    from threadloom.plans.ranking import global_rank

    return durable(global_rank(nodes, ["id"]).withColumn("v", F.col("rank") - 1).drop("rank"))


def numbered_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """links (a, b) by the numbers of ``ids`` (id, v)."""
    va, vb = ids.select(F.col("id").alias("a"), F.col("v").alias("va")), ids.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return durable(links.select("a", "b").join(va, "a").join(vb, "b").select(F.col("va").alias("a"), F.col("vb").alias("b")))


def betweenness(edges: DataFrame, sources: int | None = None, wave_rows: int = WAVE_ROWS, peels: int = 16, held: int = source_blocks.HELD_ENDS) -> DataFrame:
    """(id, betweenness), un-normalised, exact at every size.

    Leaves are cut off round by round (``peels`` at most) and their shares written down in closed form, as the only way from
    a leaf is its neighbour; a vertex then stands for what hung on it. In what is left, counts of shortest paths spread
    level by level from every source, and dependencies flow back: where a task may hold the edges (``held`` ends at most)
    blocks of sources are dealt over the tasks (``source_blocks``), so no state of (source, vertex) is ever stored; beyond,
    by joins from a wave of sources at a time, which holds ``wave_rows`` rows of state at most. ``sources``: only that
    many (smallest hashes), scaled; ``sources_for`` gives their number for an error.
    """
    links = durable(both_ways(edges.select("a", "b").where("a <> b")).distinct())
    comp = components(links)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n"))
    comp = durable(comp)
    nodes = durable(spread_join(comp, durable(size), "component", comp.count()).select("id", "size", F.lit(1).cast("bigint").alias("reach"), F.lit(0.0).alias("b")))
    n = nodes.count()
    for _ in range(peels):
        ends = links.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.min("b").alias("parent")).where("d = 1").select("a", "parent")
        mutual = ends.select(F.col("a").alias("parent"), F.col("parent").alias("a")).withColumn("twin", F.lit(True))
        # of two leaves that have but each other the smaller one stays
        leaves = durable(ends.join(mutual, ["a", "parent"], "left").where(F.col("twin").isNull() | (F.col("a") > F.col("parent"))).select(F.col("a").alias("id"), "parent"))
        if leaves.isEmpty():
            break
        gone = durable(leaves.join(nodes, "id"))
        given = gone.groupBy(F.col("parent").alias("id")).agg(F.sum("reach").alias("more"), F.sum(F.col("reach") * (F.col("size") - F.col("reach") - 1)).cast("double").alias("via"))
        own = gone.select("id", ((F.col("reach") - 1) * (F.col("size") - F.col("reach"))).cast("double").alias("below"))
        nodes = durable(nodes.join(given, "id", "left").join(own, "id", "left").select(
            "id", "size", (F.col("reach") + F.coalesce("more", F.lit(0))).alias("reach"),
            (F.col("b") + F.coalesce("via", F.lit(0.0)) + F.coalesce("below", F.lit(0.0))).alias("b"),
        ))
        cut = leaves.select("id")
        links = durable(links.join(cut.withColumnRenamed("id", "a"), "a", "left_anti").join(cut.withColumnRenamed("id", "b"), "b", "left_anti"))
    reach = nodes.select(F.col("id").alias("b"), F.col("reach").alias("rb"))
    links = durable(links.join(reach, "b").select("a", "b", "rb"))
    core = durable(links.select(F.col("b").alias("id"), "rb").distinct())
    m = core.count()
    chosen = core if not sources else core.orderBy(F.xxhash64("id"), "id").limit(sources)
    asked = min(m, sources or m)
    ends = links.count()
    if m and ends <= held and m <= source_blocks.HELD_VERTICES:
        ids = numbered(core)
        start = ids if not sources else ids.orderBy(F.xxhash64("id"), "id").limit(sources)
        flow = source_blocks.dependencies(numbered_links(links, ids), ids.select("v", F.col("rb").alias("w")), start.select("v"), (ends, m, asked))
        total = durable(flow.join(ids, "v").select("id", "x"))
        waves = 0
    else:
        waves, total = max(1, -(-asked * m // wave_rows)), None
    for k in range(waves if m else 0):
        part = durable(_dependencies(links, chosen.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == k)))
        total = part if total is None else durable(total.unionByName(part).groupBy("id").agg(F.sum("x").alias("x")))
    if total is None:
        total = nodes.select("id", F.lit(0.0).alias("x")).limit(0)
    whole = F.col("b") + F.coalesce("x", F.lit(0.0)) * (m / max(1, asked))
    return nodes.join(total, "id", "left").select("id", F.round(whole / 2, 6).alias("betweenness"))


def _dependencies(links: DataFrame, start: DataFrame) -> DataFrame:
    """(id, x): summed dependencies on the sources ``start`` (id, rb), each as often as the vertices it stands for.

    What flows back through a vertex is its own ``rb`` and what its successors pass on; without itself, that is the number of
    (shares of) shortest paths that go on from it.
    """
    front = durable(start.select(F.col("id").alias("s"), F.col("rb").alias("rs"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.col("rb").alias("rv")))
    levels = [front]
    while True:
        step = front.join(links, front["v"] == links["a"]).groupBy("s", "rs", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"), F.max("rb").alias("rv"))
        # over undirected edges a neighbour of a level lies in it, in the one before, or has not been met
        for seen in levels[-2:]:
            step = step.join(seen.select("s", "v"), ["s", "v"], "left_anti")
        front = durable(step)
        if front.isEmpty():
            break
        levels.append(front)
    below, out = levels[-1].withColumn("mass", F.col("rv").cast("double")), None
    for level in reversed(levels[:-1]):
        part = below.select(F.col("v").alias("id"), (F.col("rs") * (F.col("mass") - 1)).alias("x"))
        out = part if out is None else out.unionByName(part)
        share = below.join(links, below["v"] == links["a"]).groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("mass") / F.col("paths")).alias("x"))
        below = durable(level.join(share, ["s", "v"], "left").withColumn("mass", F.col("rv") + F.coalesce("x", F.lit(0.0)) * F.col("paths")).drop("x"))
    # what is left in ``below`` are the sources themselves, which do not count
    if out is None:
        out = links.select(F.col("a").alias("id"), F.lit(0.0).alias("x")).limit(0)
    return out.groupBy("id").agg(F.sum("x").alias("x"))


def leiden(edges: DataFrame, rounds: int = 12, levels: int = 12) -> DataFrame:
    """(id, component, community): communities of (component, a, b, weight) by modularity, every one of them connected.

    A level moves vertices to the neighbouring community of the largest gain, in a round only from a community to one of a
    smaller hash (all at once would swap places for ever), as long as modularity grows. The communities are then refined: each falls into its
    connected pieces, and the pieces become the vertices of the next level, their inner weight a loop. A level that folds
    nothing ends it. Pieces of pieces are connected, so the last vertices are the communities; each bears the smallest id.
    """
    now = durable(edges.select("component", "a", "b", F.col("weight").cast("double").alias("weight")))
    member = durable(both_ways(now.select("component", "a", "b")).select("component", F.col("a").alias("id"), F.col("a").alias("node")).distinct())
    nodes = member.count()
    for level in range(levels):
        comm = _moved(now, rounds, level)
        ca, cb = comm.select(F.col("v").alias("a"), F.col("c").alias("ca")), comm.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        inner = now.join(ca, "a").join(cb, "b").where("ca = cb and a <> b").select("a", "b")
        if inner.isEmpty():
            break
        pieces = components(inner, comm.select(F.col("v").alias("id"))).withColumnRenamed("component", "piece")
        pieces = durable(pieces)
        left = pieces.select("piece").distinct().count()
        pa, pb = pieces.select(F.col("id").alias("a"), F.col("piece").alias("pa")), pieces.select(F.col("id").alias("b"), F.col("piece").alias("pb"))
        folded = now.join(pa, "a").join(pb, "b").groupBy("component", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        now = durable(folded.agg(F.sum("weight").alias("weight")))
        member = durable(member.join(pieces.withColumnRenamed("id", "node"), "node").select("component", "id", F.col("piece").alias("node")))
        if left == nodes:
            break
        nodes = left
    return member.select("id", "component", F.col("node").alias("community"))


def _moved(edges: DataFrame, rounds: int, level: int) -> DataFrame:
    """(v, c): the community of each vertex after moves that raise modularity.

    What a round offers each vertex also tells the modularity of the communities it starts from, so a round is one table and
    one sum over it.
    """
    links = durable(both_ways(edges))
    total = links.groupBy("component").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    strength = links.groupBy("component", F.col("a").alias("v")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("loop"))
    strength = durable(spread_join(strength, durable(total), "component", links.count()).select("v", "k", "total", "loop"))
    own = strength.withColumnRenamed("v", "a").drop("loop")
    others = durable(links.where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight")).join(own, "a").withColumnRenamed("a", "v"))
    loops = strength.agg(F.sum(F.col("loop") / F.col("total"))).first()[0] or 0.0
    comm = strength.select("v", F.col("v").alias("c"), "k", "total")
    best, kept, still, before, under = None, comm, 0, None, None
    for r in range(rounds + 1):
        offer = durable(_offers(others, comm))
        # a vertex's links into its own community, and its share of that community's mass
        shares = F.sum(F.col("inner") / F.col("total") - F.col("k") * F.col("mass") / (F.col("total") * F.col("total")))
        found, would = offer.agg(shares, F.count_if("s.moves")).first()
        found = (found or 0.0) + loops
        if best is None or found > best + 1e-9:
            dead, best, kept, still, under = under, found, comm, 0, before
        else:
            dead, still = (before if before is not under else None), still + 1
        if dead is not None:
            release(dead)
        if still == 2 or not would or r == rounds:  # both directions have had their turn
            break
        draw = lambda c: F.xxhash64(c, F.lit(level), F.lit(r))
        turn = draw("s.c") < draw("here")  # no two communities swap vertices
        comm = offer.select("v", F.when(F.col("s.moves") & turn, F.col("s.c")).otherwise(F.col("here")).alias("c"), "k", "total")
        before = offer
    return kept.select("v", "c")


def _offers(others: DataFrame, comm: DataFrame) -> DataFrame:
    """(v, k, total, here, inner, mass, s) of links (v, b, weight, k, total) and communities (v, c, k, total): ``s`` is the best
    community for ``v`` and whether that is a move."""
    mass = comm.groupBy("c").agg(F.sum("k").alias("mass"))
    near = others.join(comm.select(F.col("v").alias("b"), "c"), "b").select("v", "c", "weight", "k", "total", F.lit(False).alias("stays"))
    here = comm.select("v", "c", F.lit(0.0).alias("weight"), "k", "total", F.lit(True).alias("stays"))
    each = near.unionByName(here).groupBy("v", "c").agg(F.sum("weight").alias("w"), F.first("k").alias("k"), F.first("total").alias("total"), F.max("stays").alias("stays")).join(mass, "c")
    gain = F.round(F.col("w") - F.col("k") * (F.col("mass") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / F.col("total"), 9)
    # of equal gains the vertex's own community, then the smaller name
    score = F.struct((-gain).alias("loss"), (~F.col("stays")).alias("moves"), "c")
    its = lambda x: F.max(F.when(F.col("stays"), F.col(x)))
    return each.groupBy("v").agg(F.first("k").alias("k"), F.first("total").alias("total"), its("c").alias("here"), its("w").alias("inner"), its("mass").alias("mass"), F.min(score).alias("s"))


def _uniform(seed: int, salt: str, step: int) -> Column:
    """A number in [0, 1) that depends on the start, the walk's number, the step and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "start", "k", F.lit(step)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pick(items: Column, point: Column) -> Column:
    """Key of the item (key, w) in which ``point`` of the summed weights falls; the last one if rounding leads beyond."""
    first = F.struct(point.alias("left"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(
            F.struct((acc["left"] - x["w"]).alias("left"), x["key"].alias("key"), (acc["left"] < x["w"]).alias("done"))
        )

    return F.aggregate(items, first, step, lambda acc: acc["key"])


def walks_by_steps(edges: DataFrame, length: int = 40, walks: int = 10, seed: int = 42, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(walk, place, id): weighted walks from every vertex, two keyed joins a step.

    A vertex's d neighbours lie in about sqrt(d) rows of about sqrt(d) each, by hash: a step draws the row by its summed
    weight, then the neighbour inside it, so no row grows with a hub's degree. With ``p`` and ``q`` a step depends on the
    vertex before: a drawn neighbour is kept with a probability in proportion to 1/p (the way back), 1 (a neighbour of the
    vertex before, which a keyed join with the edges tells) or 1/q, and else drawn again, so its share is exact. Draws
    depend on start, walk, step, try and seed alone, so walks do not change with the partitions.
    """
    links = both_ways(edges.select("a", "b", F.col("weight").cast("double").alias("w")))
    degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.sqrt("d"))).cast("string")
    item = lambda key: F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "w")))
    lists = durable(links.join(degree, "a").groupBy("a", block.alias("block")).agg(item("b").alias("items"), F.sum("w").alias("w")))
    nodes = durable(lists.groupBy("a").agg(item("block").alias("blocks"), F.sum("w").alias("whole")))
    at = durable(nodes.select(F.col("a").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("k")).select(
        "start", "k", F.col("start").alias("id"), F.lit(None).cast("string").alias("last")
    ))
    biased = p != 1 or q != 1
    pairs = durable(links.select(F.col("a").alias("last"), F.col("b").alias("next")).distinct().withColumn("near", F.lit(True))) if biased else None
    walk = F.concat_ws("#", "start", "k").alias("walk")
    out = at.select(walk, F.lit(0).alias("place"), "id")

    def drawn(rows: DataFrame, step: int, turn: int) -> DataFrame:
        row = rows.join(nodes, rows["id"] == nodes["a"]).select(
            "start", "k", "id", "last", "a", _pick(F.col("blocks"), _uniform(seed, f"row{turn}", step) * F.col("whole")).alias("block")
        )
        return row.join(lists, ["a", "block"]).select("start", "k", "id", "last", _pick(F.col("items"), _uniform(seed, f"item{turn}", step) * F.col("w")).alias("next"))

    for step in range(1, length):
        if not biased or step == 1:
            done = drawn(at, step, 0)
        else:
            done, todo, turn = None, at, 0
            while done is None or not todo.isEmpty():
                share = F.when(F.col("next") == F.col("last"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                keeps = _uniform(seed, f"keep{turn}", step) * max(1 / p, 1.0, 1 / q) < share
                tried = durable(drawn(todo, step, turn).join(pairs, ["last", "next"], "left").withColumn("keeps", keeps))
                kept = tried.where("keeps").select("start", "k", "id", "last", "next")
                done = kept if done is None else done.unionByName(kept)
                todo, turn = tried.where("not keeps").select("start", "k", "id", "last"), turn + 1
        at = durable(done.select("start", "k", F.col("next").alias("id"), F.col("id").alias("last")))
        out = out.unionByName(at.select(walk, F.lit(step).alias("place"), "id"))
    return out

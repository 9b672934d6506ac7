"""Graph algorithms by joins against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plain_graphs import brandes, louvain, modularity, neighbours
from tests.test_graph import graph, pairs
from threadloom.operators import algorithms as A
from threadloom.operators import large_graphs as L


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight long")


def planted(groups=6, size=10, seed=3):
    """Dense groups in a ring with single edges between neighbours."""
    rnd, rows = random.Random(seed), []
    for c in range(groups):
        ids = [f"g{c}_{i}" for i in range(size)]
        rows += [(x, y, rnd.randint(2, 4)) for i, x in enumerate(ids) for y in ids[i + 1:] if rnd.random() < 0.7]
        rows.append((f"g{c}_0", f"g{(c + 1) % groups}_1", 2))
    return rows


def shaped(kind):
    rnd = random.Random(5)
    if kind == "random":
        return sorted({(f"n{min(p):02d}", f"n{max(p):02d}", 1) for p in (rnd.sample(range(24), 2) for _ in range(30))}) + [("x", "y", 1)]
    if kind == "tree":
        return [(f"t{rnd.randrange(k):02d}", f"t{k:02d}", 1) for k in range(1, 30)]
    if kind == "chain":
        return [(f"c{k:02d}", f"c{k + 1:02d}", 1) for k in range(12)]
    return planted(3, 5) + [("g0_0", f"leaf{i}", 1) for i in range(6)] + [(f"leaf{i}", f"deep{i}", 1) for i in range(3)]


@pytest.mark.parametrize("kind,wave_rows,peels", [("random", 10**9, 16), ("tree", 10**9, 16), ("chain", 10**9, 2), ("groups", 200, 16), ("groups", 10**9, 0)])
def test_betweenness_is_exact(spark, kind, wave_rows, peels):
    """Leaves in closed form, few rounds of them or none; many sources at once, or waves of few."""
    rows = shaped(kind)
    want = brandes(rows)
    got = pairs(L.betweenness(edges_of(spark, rows).unionByName(edges_of(spark, [("n01", "n01", 1)] if kind == "random" else rows[:1])), wave_rows=wave_rows, peels=peels), "id", "betweenness")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_betweenness_of_sampled_sources(spark):
    """Off by no more than the bound says; a star needs no source at all."""
    star = edges_of(spark, [("hub", f"n{i}", 1) for i in range(6)])
    assert pairs(L.betweenness(star, sources=3), "id", "betweenness")["hub"] == 15.0
    assert L.betweenness(star.limit(0)).count() == 0
    rows = planted(4, 8)
    n = len({x for r in rows for x in r[:2]})
    k = L.sources_for(n, 0.45)
    assert k < n and L.sources_for(10**9, 0.01) < 130_000
    want, got = brandes(rows), pairs(L.betweenness(edges_of(spark, rows), sources=k), "id", "betweenness")
    assert all(abs(got[v] - want[v]) <= 0.45 * n * (n - 2) / 2 for v in want) and any(got[v] != want[v] for v in want)


def test_bridges(spark):
    g = graph(spark, [], cooc=[("a", "b", 2), ("b", "c", 2), ("c", "d", 2)])
    assert {(r.entity_a, r.entity_b): (r.path_length, r.betweenness) for r in A.entity_bridges(g).collect()}["b", "d"] == (2, 1.0)


def test_betweenness_stores_no_pairs(spark, monkeypatch):
    """Blocks of sources give what joins give, and no stored table has a row for each source and vertex."""
    rnd = random.Random(9)
    rows = sorted({(f"n{min(p):02d}", f"n{max(p):02d}", 1) for p in (rnd.sample(range(60), 2) for _ in range(140))})
    stored, write = [], L.durable
    monkeypatch.setattr(L, "durable", lambda df: stored.append(write(df)) or stored[-1])
    want, got = brandes(rows), pairs(L.betweenness(edges_of(spark, rows)), "id", "betweenness")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert max(df.count() for df in stored) <= 2 * len(rows)
    joined = pairs(L.betweenness(edges_of(spark, rows), held=0), "id", "betweenness")
    assert all(abs(joined[k] - want[k]) < 1e-5 for k in want)


def test_bridges_of_some_sources(spark):
    """Counts, the first source and given sources agree with all bridges, by blocks and by joins."""
    g = graph(spark, [], cooc=[(a, b, 2) for a, b, _ in planted(3, 5)] + [("a0", "g0_0", 2), ("z0", "z1", 2)])
    every = {tuple(r) for r in A.entity_bridges(g).collect()}
    assert every == {tuple(r) for r in A.entity_bridges(g, held=0).collect()} and every
    assert A.count_bridges(g).first().n == A.count_bridges(g, held=0).first().n == len(every)
    smallest = min(r[0] for r in every)
    assert {tuple(r) for r in A.first_bridges(g, batch=1).collect()} == {r for r in every if r[0] == smallest}
    some = A.bridges_by_source(g)(spark.createDataFrame([("g1_0",), ("a0",)], "id string"))
    assert {tuple(r) for r in some.collect()} == {r for r in every if r[0] == "g1_0"}
    none = graph(spark, [], cooc=[("a", "b", 2)])
    assert A.first_bridges(none).count() == A.entity_bridges(none).count() == A.count_bridges(none).first().n == 0


def connected(rows, part):
    near = neighbours(rows)
    for c in set(part.values()):
        own = {v for v in part if part[v] == c}
        seen, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [t for t in near[v] if t in own]
        if seen != own or c != min(own):
            return False
    return True


@pytest.mark.parametrize("rows", [planted(10, 8, 4), shaped("groups") + shaped("tree")], ids=["ring", "mixed"])
def test_communities_by_joins(spark, rows):
    """As good as moving one vertex after the other, and every community connected and named by its smallest id."""
    found = A.communities(graph(spark, [], cooc=rows), least=1).collect()
    part = {r.id: r.community for r in found}
    assert connected(rows, part) and len(found) == len({x for r in rows for x in r[:2]})
    assert modularity(rows, part) >= modularity(rows, louvain(rows)) - 0.01
    e = edges_of(spark, rows)
    got = A.partition_modularity(e, spark.createDataFrame(list(part.items()), "id string, community string")).first()
    assert got.communities == len(set(part.values())) and abs(got.modularity - modularity(rows, part)) < 1e-6


def test_rounds_do_not_blow_up_the_guessed_size(spark):
    """Spark guesses a join's size as a product; carried over rounds its digits double each time, and planning never ends."""
    from threadloom.session import durable, release

    now = spark.createDataFrame([(f"v{i}", f"v{i % 3}") for i in range(9)], "v string, c string")
    for _ in range(6):
        old, now = now, durable(now.join(now.select(F.col("v").alias("w"), "c"), "c").groupBy("v").agg(F.min("c").alias("c")))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    release(old)
    assert {r.v: r.c for r in now.collect()} == {f"v{i}": f"v{i % 3}" for i in range(9)}


def test_pieces_of_a_component_stay_apart(spark):
    """Two cliques without an edge between them are two components, whatever the size limit of components."""
    rows = [(f"{c}{i}", f"{c}{j}", 2) for c in "ab" for i in range(4) for j in range(i + 1, 4)] + [("z0", "z1", 2)]
    found = A.communities(graph(spark, [], cooc=rows)).collect()
    assert {(r.component, r.community) for r in found} == {("a0", "a0"), ("b0", "b0")}


@pytest.mark.parametrize("hot", [1, 1 << 14])
def test_spread_join(spark, monkeypatch, hot):
    from threadloom.operators import spread

    monkeypatch.setattr(spread, "HOT_KEYS", hot)
    monkeypatch.setattr(spread, "_LEAST", 2)
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, x int")
    keyed = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B")], "k string, n long, name string")
    got = spread.spread_join(rows, keyed, "k", 52).groupBy("k", "name").count().collect()
    assert {tuple(r) for r in got} == {("a", "A", 50), ("b", "B", 1)}


def test_walks_by_steps(spark):
    rows = [("hub", f"n{i:02d}", 1 + 9 * (i == 0)) for i in range(30)]
    e = edges_of(spark, rows)
    got = L.walks_by_steps(e, 4, 200).collect()
    paths = {}
    for r in got:
        paths.setdefault(r.walk, {})[r.place] = r.id
    assert len(paths) == 31 * 200 and all(sorted(p) == [0, 1, 2, 3] for p in paths.values())
    known = {x for a, b, _ in rows for x in ((a, b), (b, a))}
    assert all((p[i], p[i + 1]) in known for p in paths.values() for i in range(3))
    seen = Counter(p[i + 1] for p in paths.values() for i in range(3) if p[i] == "hub")
    total = sum(seen.values())
    assert abs(seen["n00"] / total - 10 / 39) < 0.03
    assert np.std([seen[f"n{i:02d}"] / total for i in range(1, 30)]) < 0.01
    again = Counter((r.place, r.id) for r in L.walks_by_steps(e.repartition(3), 4, 200).collect())
    assert again == Counter((r.place, r.id) for r in got)


def test_biased_walks_have_exact_shares(spark):
    """Second-order steps: shares of each (last, here, next) against the weights over p and q."""
    rows = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "d", 3), ("d", "e", 1), ("c", "e", 1)]
    p, q = 0.5, 3.0
    got = L.walks_by_steps(edges_of(spark, rows), 4, 600, seed=7, p=p, q=q).collect()
    paths = {}
    for r in got:
        paths.setdefault(r.walk, {})[r.place] = r.id
    assert len(paths) == 5 * 600 and all(len(x) == 4 for x in paths.values())
    near, seen = neighbours(rows), Counter((x[i], x[i + 1], x[i + 2]) for x in paths.values() for i in range(2))
    for u, v in {k[:2] for k in seen}:
        weight = {x: w / p if x == u else w if x in near[u] else w / q for x, w in near[v].items()}
        n = sum(c for k, c in seen.items() if k[:2] == (u, v))
        for x, w in weight.items():
            share = w / sum(weight.values())
            assert abs(seen[u, v, x] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-9
    again = L.walks_by_steps(edges_of(spark, rows[::-1]).repartition(3), 4, 600, seed=7, p=p, q=q).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))

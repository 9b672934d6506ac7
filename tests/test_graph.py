"""Operators on small graphs with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import ontology
from threadloom.graph import EDGES, NODE, Graph, build, known_terms, merge
from threadloom.operators import algorithms as A
from threadloom.operators import embedding as E
from threadloom.operators import relational as R
from threadloom.operators import temporal as T
from threadloom.operators import text as X
from threadloom.operators import traversal as V
from threadloom.plans.ranking import global_rank
from threadloom.streaming import incremental as N


def graph(spark, nodes, **edges):
    full = [tuple(n) + (None,) * (7 - len(n)) for n in nodes]
    tables = {t: spark.createDataFrame([tuple(e) for e in edges.get(t, [])], s) for t, s in EDGES.items()}
    return Graph(spark.createDataFrame(full, NODE), **tables)


def ent(kind, name):
    return (f"entity::{kind}::{name}", "Entity", "", "", name, kind)


def msg(i, text="", role="user", t=None):
    return (f"msg::{i}", "Message", role, text, "", "", t)


ALICE, OPENAI, AI, BOB = (f"entity::{k}::{n}" for k, n in (("PERSON", "alice"), ("ORG", "openai"), ("TOPIC", "ai"), ("PERSON", "bob")))


@pytest.fixture(scope="module")
def served(spark):
    return graph(
        spark,
        [("conv::c1", "Conversation", "", "", "", ""), msg(1, "Hello alice", t=1_000_000.0), msg(2, "Hi", "assistant"), msg(3, "More"), msg(4, "x", t=1_000_100.0),
         ent("PERSON", "alice"), ent("ORG", "openai"), ent("TOPIC", "ai"), ("kw::hello", "Keyword", "", "", "hello", ""), ("kw::world", "Keyword", "", "", "world", "")],
        contains=[("conv::c1", f"msg::{i}") for i in range(1, 5)],
        replies=[("msg::1", "msg::2"), ("msg::2", "msg::3")],
        mentions=[("msg::1", ALICE), ("msg::1", OPENAI), ("msg::2", AI), ("msg::4", ALICE)],
        cooc=[(ALICE, OPENAI, 1), (AI, OPENAI, 1), (AI, ALICE, 1)],
        keywords=[("msg::1", "kw::hello", 0.5), ("msg::2", "kw::world", 0.3)],
    )


def pairs(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_stats(served):
    s = {(r.kind, r.key): r.n for r in R.graph_stats(served).collect()}
    assert s["total", "nodes"] == 10 and s["label", "Entity"] == 3 and s["label", "Message"] == 4
    assert s["edge", "MENTIONS"] == 4 and s["edge", "CO_OCCURS_WITH"] == 3


def test_search(served):
    assert [r.id for r in R.search_entities(served, "ali").collect()] == [ALICE]
    assert [r.id for r in R.search_entities(served, "a", "org").collect()] == [OPENAI]
    assert R.top_entities(served).first().mention_count == 2
    assert R.search_keywords(served, "hello").first().avg_weight == 0.5
    assert [r.place for r in R.search_text(served, "ALICE").collect()] == [7]
    assert R.entity_timeline(served, ALICE, OPENAI).count() == 1


def test_triangle_has_no_betweenness(served):
    rows = A.entity_centrality(served, least=1).collect()
    assert {(r.betweenness, r.degree) for r in rows} == {(0.0, 2)}


def test_temporal(served):
    m = {r.entity_id: r for r in T.metrics(served).collect()}
    assert (m[ALICE].total, m[ALICE].first, m[ALICE].active_buckets, m[ALICE].cv, m[ALICE].bursts) == (2, "1970-01", 1, 0.0, 0)
    assert {r.bucket for r in T.bucketed(served).collect()} == {"1970-01", "unknown"}


def test_coactivation(spark):
    g = graph(spark, [msg(1, t=1e6), msg(2, t=1.01e6), msg(3, t=2e6)], mentions=[("msg::1", ALICE), ("msg::2", AI), ("msg::3", ALICE)])
    (r,) = T.coactivation(g).collect()
    assert (r.a, r.b, r.buckets, r.share) == (ALICE, AI, 1, 100.0) or (r.b, r.a) == (ALICE, AI)


def test_path_betweenness(spark):
    g = graph(spark, [ent("PERSON", "alice"), ent("ORG", "openai"), ent("PERSON", "bob")], cooc=[(OPENAI, ALICE, 1), (OPENAI, BOB, 1)])
    assert pairs(A.entity_centrality(g, least=1), "id", "betweenness") == {OPENAI: 1.0, ALICE: 0.0, BOB: 0.0}
    b = A.entity_bridges(g, least=1).collect()
    assert b == []  # the only bridge has no target two hops away


def test_bridges(spark):
    chain = [("a", "b", 2), ("b", "c", 2), ("c", "d", 2)]
    g = graph(spark, [], cooc=chain)
    got = {(r.entity_a, r.entity_b): (r.path_length, r.betweenness) for r in A.entity_bridges(g).collect()}
    assert got == {("b", "d"): (2, 1.0), ("c", "a"): (2, 1.0)}


@pytest.fixture(scope="module")
def chain(spark):
    return graph(
        spark, [msg(i, f"t{i}") for i in range(1, 6)],
        contains=[("c1", f"msg::{i}") for i in range(1, 5)] + [("c2", "msg::5")], replies=[(f"msg::{i}", f"msg::{i + 1}") for i in range(1, 4)],
    )


def test_depth(chain):
    d = {r.conv_id: r for r in V.depth_by_conversation(chain).collect()}
    assert (d["c1"].max_depth, d["c1"].mean_depth, d["c1"].branching) == (4, 2.5, 1.0) and (d["c2"].max_depth, d["c2"].branching) == (1, 0.0)
    assert pairs(V.depth_distribution(chain), "conv_id", "distribution") == {"c1": "1:1 2:1 3:1 4:1", "c2": "1:1"}
    assert pairs(V.ancestor_counts(chain), "id", "depth") == {f"msg::{i}": max(0, i - 1) if i < 5 else 0 for i in range(1, 6)}
    assert pairs(V.message_centrality(chain), "id", "betweenness") == {"msg::1": 0, "msg::2": 2, "msg::3": 2, "msg::4": 0, "msg::5": 0}
    assert pairs(V.context(chain, "msg::2", 1), "id", "hop") == {"msg::1": -1, "msg::2": 0, "msg::3": 1}
    assert [r.msg_id for r in V.conversation_order(chain, "c1").orderBy("place").collect()] == [f"msg::{i}" for i in range(1, 5)]


def test_longest_path_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdxy"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "parent_id string, child_id string")
    assert pairs(V.longest_depth(nodes, e), "id", "depth") == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert V.ancestors(e).count() == 6 + 4


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("z1", "z0")], "a string, b string")
    n = spark.createDataFrame([("lone",), ("z0",)], "id string")
    got = pairs(V.components(e), "id", "component")
    assert set(got.values()) == {"n00", "z0"} and len(got) == 33
    assert pairs(V.components(e, n), "id", "component") == {"lone": "lone", "z0": "z0"}


@pytest.mark.parametrize("least", [0.0, 0.02, 0.2, 0.3, 0.6])
def test_weighted_similarity(spark, least):
    """Every pair of conversations with entities, those that share keywords alone too; one feature is held by all."""
    import random

    rng = random.Random(7)
    ents = {f"c{i:02d}": {"all"} if i % 9 == 0 else {f"e{rng.randrange(12)}" for _ in range(rng.randint(0, 4))} for i in range(30)} | {"x": {"p"}, "y": {"q"}}
    keys = {c: {f"k{rng.randrange(6)}" for _ in range(rng.randint(0, 3))} for c in ents} | {"x": {"same", "kw"}, "y": {"same", "kw"}}
    g = graph(
        spark, [], contains=[(c, f"m-{c}") for c in ents], mentions=[(f"m-{c}", e) for c, es in ents.items() for e in es], keywords=[(f"m-{c}", k, 1.0) for c, ks in keys.items() for k in ks],
    )
    part = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {(a, b): round(0.7 * part(ents[a], ents[b]) + 0.3 * part(keys[a], keys[b]), 6) for a in ents for b in ents if a < b and ents[a] and ents[b]}
    got = {(r.a, r.b): r.score for r in R.conversation_similarity(g, least, keywords=True).collect()}
    assert got == {k: s for k, s in want.items() if s >= least}
    assert least > 0.3 or got["x", "y"] == 0.3


def test_similarity(spark):
    g = graph(spark, [], contains=[("a", "m1"), ("b", "m2"), ("c", "m3")], mentions=[("m1", "x"), ("m1", "y"), ("m2", "z"), ("m3", "x")], keywords=[("m1", "k", 1.0), ("m3", "k", 1.0)])
    assert [(r.a, r.b, r.score) for r in R.conversation_similarity(g).collect()] == [("a", "c", 0.5)]
    assert len(R.conversation_similarity(g, 0.0).collect()) == 3
    assert R.conversation_similarity(g, keywords=True).first().score == 0.65
    assert [r.conv_id for r in R.similar_conversations(g, "c").collect()] == ["a"]
    assert [(r.msg_a, r.msg_b) for r in R.cross_links(g).collect()] == [("m1", "m3")]


def test_query_scores(spark):
    g = graph(
        spark, [ent("T", "fibonacci"), ent("T", "numbers"), ("kw::sequence", "Keyword", "", "", "sequence", ""), msg(1), msg(2)],
        contains=[("c", "msg::1"), ("c", "msg::2")], mentions=[("msg::1", "entity::T::fibonacci"), ("msg::2", "entity::T::fibonacci"), ("msg::2", "entity::T::numbers")],
        keywords=[("msg::2", "kw::sequence", 0.4)],
    )
    assert pairs(R.query_messages(g, "Fibonacci sequence"), "msg_id", "score") == {"msg::2": 2.5, "msg::1": 1.5}
    assert R.query_messages(g, "quantum").count() == 0
    assert {r.msg_id for r in R.semantic_search(g, "fibonacci").collect()} == {"msg::1", "msg::2"}
    assert pairs(R.related_entities(g, "entity::T::numbers"), "entity_id", "co_mentions") == {"entity::T::fibonacci": 1}


def test_diff(spark):
    both = [("kw::k", "Keyword", "", "", "k", ""), ("c", "Conversation", "", "", "", "")]
    a = graph(spark, [ent("PERSON", "alice"), ent("ORG", "openai"), *both], mentions=[("m1", ALICE)])
    b = graph(spark, [ent("PERSON", "alice"), ent("PERSON", "bob"), *both], mentions=[("m1", ALICE), ("m1", BOB)])
    d = {r.kind: r for r in R.diff_counts(a, b).collect()}
    assert (d["Entity"].shared, d["Entity"].jaccard, d["Keyword"].jaccard) == (1, round(1 / 3, 6), 1.0)
    top = R.diff_mentions(a, b).first()
    assert (top.entity_id, top["diff"], top.lean) == (BOB, 1, "right")


def test_build_and_merge(spark):
    schema = "id string, role string, text string, parent string, create_time double, conversation_id string, lang string"
    rows = [("m1", "user", "Alice works at OpenAI", None, 1.0, "c", "en"), ("m2", "assistant", "Bob is from Google", "m1", None, "c", "en"), ("m3", "user", "gone", "nobody", None, "c", "fr")]
    m = spark.createDataFrame(rows, schema)
    who = known_terms({"Alice": "PERSON", "Bob": "PERSON", "OpenAI": "ORG", "Google": "ORG"})
    g = build(m, who)
    assert g.of("Entity").count() == 4 and g.mentions.count() == 4 and g.cooc.count() == 2 and g.replies.count() == 1
    assert build(m, who, ("en",)).of("Message").count() == 2
    once, seen = N.extend(Graph.empty(spark), spark.createDataFrame([], "id string"), m.limit(1))
    again, seen = N.extend(once, seen, m)
    assert again.of("Message").count() == 3 and seen.count() == 3
    kept = merge(g, graph(spark, [("m1", "Message", None, None, None, None, None)]))
    assert kept.nodes.where("id = 'm1'").first().create_time == 1.0


def test_storage(spark, served, tmp_path):
    served.write(str(tmp_path))
    back = Graph.read(spark, str(tmp_path))
    assert back.nodes.count() == 10 and back.of("Entity").count() == 3 and back.cooc.count() == 3


def test_ontology(spark, served):
    assert ontology.edges(spark).count() == len(ontology.EDGES)
    assert ontology.violations(served.nodes).count() == 0
    assert ontology.violations(graph(spark, [("x", "Odd"), ("k", "Keyword", "user")]).nodes).count() == 2


def test_svd(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 12)) * np.array([9, 6, 4, 2.5, 1.5] + [0.3] * 7)
    cells = spark.createDataFrame([(f"r{i:02d}", f"c{j}", float(m[i, j])) for i in range(30) for j in range(12)], "row string, col string, value double")
    u, sigma = E.svd(cells, 3)
    want_u, want, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(sigma, want[:3], rtol=1e-3)
    got = np.array([r.vector for r in u.orderBy("row").collect()])
    assert np.allclose(np.abs(got.T @ want_u[:, :3]), np.eye(3), atol=0.05)


def test_walks_and_neighbours(spark):
    g = graph(spark, [], cooc=[("a", "b", 2), ("b", "c", 3), ("c", "a", 2)])
    w = A.random_walks(g, 5, 2)
    assert w.count() == 3 * 2 * 5 and sorted(map(repr, w.collect())) == sorted(map(repr, A.random_walks(g, 5, 2).collect()))
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<double>")
    assert [(r.id, r.cosine) for r in E.nearest(v, "a").collect()] == [("b", 1.0), ("c", 0.0), ("z", 0.0)]
    assert E.nearest(v, "z").count() == 0 and E.nearest(v, "a", top=1).count() == 1


def test_dedup_and_rank(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, "")], "seq long, text string")
    assert sorted(r.seq for r in X.dedup_exact(df).collect()) == [1, 2, 4]
    ranked = global_rank(spark.range(1000).withColumn("id", 1000 - F.col("id")), ["id"])
    assert ranked.where("rank = id").count() == 1000


def test_cluster_report(spark):
    g = graph(spark, [], cooc=[("a", "b", 2), ("b", "c", 2), ("a", "c", 2)], mentions=[("m", "a")], keywords=[("m", "k", 1.0)])
    (r,) = A.topic_clusters(g).collect()
    assert (r["size"], r.edges, r.keywords) == (3, 3, "k")
    assert {x.domain for x in A.entity_domains(g).collect()} == {"a, b, c"}


def test_longest_depth_is_whole_or_refused(spark):
    from threadloom.operators.traversal import longest_depth

    nodes = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    replies = spark.createDataFrame([(str(i), str(i + 1)) for i in range(4)], "parent_id string, child_id string")
    assert {r.id: r.depth for r in longest_depth(nodes, replies, most=1).collect()} == {str(i): i + 1 for i in range(5)}
    short = replies.union(spark.createDataFrame([("0", "4")], replies.schema))  # two parents: steps, one per level
    assert {r.id: r.depth for r in longest_depth(nodes, short, most=5).collect()} == {str(i): i + 1 for i in range(5)}
    with pytest.raises(RuntimeError):
        longest_depth(nodes, short, most=4)


def test_forests_are_climbed_by_doubling(spark):
    """Depths and subtree sizes of random forests and a long chain against walking up by hand."""
    import random

    rnd = random.Random(11)
    up = {f"n{i}": f"n{rnd.randrange(max(0, i - 4), i)}" for i in range(1, 120) if i % 37}
    up |= {f"c{i}": f"c{i - 1}" for i in range(1, 90)}
    ids = [f"n{i}" for i in range(120)] + [f"c{i}" for i in range(90)] + ["lone"]
    chain = {x: [] for x in ids}
    for x in ids:
        y = x
        while y in up:
            y = up[y]
            chain[x].append(y)
    below = {x: sum(x in c for c in chain.values()) for x in ids}
    g = graph(spark, [(x, "Message") for x in ids], replies=[(p, c) for c, p in up.items()])
    nodes = g.of("Message").select("id")
    assert {r.id: r.depth for r in V.longest_depth(nodes, g.replies, most=1).collect()} == {x: len(c) + 1 for x, c in chain.items()}
    assert pairs(V.ancestor_counts(g), "id", "depth") == {x: len(c) for x, c in chain.items()}
    assert pairs(V.message_centrality(g), "id", "betweenness") == {x: len(c) * below[x] for x, c in chain.items()}
    loop = graph(spark, [(x, "Message") for x in "abc"], replies=[("a", "b"), ("b", "a"), ("b", "c")])
    assert V.longest_depth(loop.of("Message").select("id"), loop.replies).count() == 0
    assert pairs(V.ancestor_counts(loop), "id", "depth") == {"a": 2, "b": 2, "c": 2}

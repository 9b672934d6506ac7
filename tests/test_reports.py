"""Reports as CSV, compressed vectors, attribute dictionaries and the scalars that they use, on results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.graph import build
from threadloom.operators import algorithms as A
from threadloom.operators import reports as P
from threadloom.plans.reports import written
from threadloom.sinks import exports as K
from threadloom.sources import exports as I

MESSAGE = "id string, role string, text string, parent string, create_time double, conversation_id string, lang string"


def graph(spark, rows):
    return build(spark.createDataFrame([(i, "user", t, p, at, c, "en") for i, t, p, at, c in rows], MESSAGE))


@pytest.fixture(scope="module")
def talk(spark):
    """Two conversations; Alpha and Bravo meet twice in the first, Delta stands alone in the second."""
    return graph(spark, [
        ("m1", ' "Alpha", Bravo\nfirst', None, 0.0, "c1"), ("m2", "Alpha with Bravo", "m1", 86400.0, "c1"),
        ("m3", "Bravo again", "m1", 40 * 86400.0, "c1"), ("m4", "Delta", None, None, "c2"),
    ])


def test_csv_keeps_texts_and_types(spark, tmp_path):
    rows = [(' a "quoted", text\nof two lines\\', 1234567.0, 5), ("", None, None), (None, -0.5, 7), ("\\", 0.12345, 1)]
    df = spark.createDataFrame(rows, "t string, x double, n bigint")
    K.write_report(df, str(tmp_path / "r"), 2)
    back = I.read_csv(spark, str(tmp_path / "r"), "t string, x double, n bigint")
    assert {tuple(r) for r in back.collect()} == {(' a "quoted", text\nof two lines\\', 1234567.0, 5), (None, None, None), (None, -0.5, 7), ("\\", 0.12, 1)}
    assert any("1234567.00" in line for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines())
    assert written(df.limit(0)).count() == 0


def test_depth_report(talk):
    got = {r.conv_id: r for r in written(P.depth(talk)).collect()}
    assert got["c1"].title == ' "Alpha", Bravo\nfirst' and got["c1"].messages_in_chain == 3
    assert (got["c1"].max_depth, got["c1"].mean_depth, got["c1"].branching_factor, got["c1"].depth_distribution) == (2, 1.6667, 2.0, "1:1 2:2")
    assert (got["c2"].max_depth, got["c2"].branching_factor) == (1, 0.0)


def test_temporal_timeline_and_query_reports(talk):
    t = {r.name: r for r in P.temporal(talk).collect()}
    assert (t["Bravo"].total_mentions, t["Bravo"].first_bucket, t["Bravo"].last_bucket, t["Bravo"].active_buckets) == (3, "1970-01", "1970-02", 2)
    wide = written(P.timeline(talk, top=1)).collect()
    assert {(r.bucket, r["entity::ORG::bravo"]) for r in wide} == {("1970-01", 2), ("1970-02", 1), ("unknown", 0)}
    hit = {r.msg_id: r for r in P.found(talk, "delta").collect()}
    assert set(hit) == {"m4"} and hit["m4"].entities == "Delta" and hit["m4"].conversation_id == "c2" and hit["m4"].timestamp is None


def test_centrality_topics_difference_similarity(spark, talk):
    assert {(r.name, r.betweenness, r.degree) for r in P.centrality(talk).collect()} == {("Alpha", 0.0, 1), ("Bravo", 0.0, 1)}
    ring = "Alpha Bravo Charlie"
    g = graph(spark, [(f"m{i}", ring if i < 2 else "Delta Edison Foxtrot", None, 1.0, "c") for i in range(4)])
    got = P.topics(g).collect()
    assert len(got) == 6 and {r.degree_in_cluster for r in got} == {2} and len({r.cluster for r in got}) == 2
    d = {r.name: (r.left_mentions, r.right_mentions, r.difference, r.lean) for r in P.difference(talk, g).collect()}
    assert d["Bravo"] == (3, 2, 1, "left") and d["Charlie"] == (0, 2, 2, "right") and d["Alpha"] == (2, 2, 0, "equal")
    s = P.similarity(talk, 0.0).collect()
    assert [(r.jaccard, r.conv_id_a, r.conv_id_b, r.title_b) for r in s] == [(0.0, "c1", "c2", "Delta")]


def test_partition_modularity(spark):
    """Two triangles joined by one edge: 6/7 of the weight is inside, each side has half the strength."""
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    edges = spark.createDataFrame([(x, y, 1) for x, y in e], "a string, b string, weight bigint")
    halves = spark.createDataFrame([(v, "l" if v < "d" else "r") for v in "abcdef"], "id string, community string")
    assert tuple(A.partition_modularity(edges, halves).first()) == (6, 2, round(6 / 7 - 0.5, 6))
    assert tuple(A.partition_modularity(edges, halves.withColumn("community", F.lit("x"))).first()) == (6, 1, 0.0)
    assert tuple(A.partition_modularity(edges.limit(0), halves.limit(0)).first()) == (0, 0, 0.0)


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 1.0], "y"), (3, [0.0, 2.0], "z"), (4, [0.0, 0.0], "n")], "k bigint, v array<double>, l string")
    assert [tuple(r) for r in P.neighbours(v, F.col("k") == 1, "k", "v", ["l"]).collect()] == [(2, 0.7071, "y"), (3, 0.0, "z"), (4, 0.0, "n")]
    assert P.neighbours(v, F.col("k") == 9, "k", "v", ["l"]).count() == 0


def test_npz_and_dictionaries_come_back(spark, talk):
    v = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(9)], "k bigint, v array<float>").repartition(3)
    blocks = K.to_npz(v, "k", "v")
    assert blocks.count() <= 3
    assert {(r.id, tuple(r.vector)) for r in I.npz_rows(blocks).collect()} == {(str(i), (float(i), 0.5)) for i in range(9)}
    assert I.npz_rows(K.to_npz(v.limit(0), "k", "v")).count() == 0
    old = talk.nodes.withColumn("create_time", F.nullif("create_time", F.lit(0.0)))
    new = I.nodes_of_dicts(K.graph_dict(talk))
    assert sorted(map(tuple, new.select(old.columns).collect()), key=str) == sorted(map(tuple, old.collect()), key=str)


def test_a_file_of_many_lines_is_one_row(spark, tmp_path):
    """An export that is laid out over lines is read whole, and parsed."""
    doc = {"conversation_id": "c1", "mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["one\ntwo"]}}, "parent": None}}}
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "y.md").write_text("# T\n#### You:\nhi\n\n#### ChatGPT:\nhello\nagain\n")
    files = I.read_files(spark, str(tmp_path))
    assert files.count() == 1 and len(files.select("path").collect()) == 1
    assert [(r.conversation_id, r.role, r.text) for r in I.extract(files).collect()] == [("c1", "user", "one\ntwo")]
    got = I.parse(I.collect_files(spark, str(tmp_path))).where("source_format = 'openai_md'").first()
    assert (got.title, [(m.role, m.content) for m in got.messages]) == ("T", [("user", "hi"), ("assistant", "hello\nagain")])


def test_scalars(spark):
    df = spark.range(1).select(
        S.iso_micros(F.lit(1704067207.179575)).alias("iso"), S.plain_time(F.lit(-0.5)).alias("plain"), S.jaccard(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("half"),
        S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("none"),
        F.xpath_string(F.concat(F.lit('<a t="'), S.xml_text(F.lit('1\t<2>\r\n"3" &\x01')), F.lit('"/>')), F.lit("a/@t")).alias("xml"),
        S.is_base64(F.repeat(F.lit("QUJD"), 50_000)).alias("long"), S.is_base64(F.concat(F.repeat(F.lit("QUJD"), 30), F.lit("QQ=="))).alias("padded"),
        S.is_base64(F.concat(F.repeat(F.lit("QUJD"), 30), F.lit("Q==="))).alias("bad"), S.is_base64(F.repeat(F.lit("QUJD"), 3)).alias("short"),
    )
    r = df.first()
    assert (r.iso, r.plain, r.half, r.none) == ("2024-01-01T00:00:07.179575Z", "1969-12-31 23:59:59", 0.5, 0.0)
    assert r.xml == '1\t<2>\r\n"3" &' and (r.long, r.padded, r.bad, r.short) == (True, True, False, False)

"""Sources, scalar functions, sinks and streams."""

import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.sinks import exports as K
from threadloom.sources import exports as I
from threadloom.streaming import incremental as N
from tests.test_graph import graph, msg


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, noise",
    [("A" * 100, True), ("A" * 99, False), ("data:image/png;base64,xx", True), ("hello", False), ("A" * 98 + "==", True), ("!" * 120, False), ("x asset_pointer y", True), ("", False)],
)
def test_noise(spark, text, noise):
    assert one(spark, text, S.is_noise) is noise


@pytest.mark.parametrize(
    "text, want",
    [(None, None), ("1700000000", 1.7e9), ("1700000000000", 1.7e9), ("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T00:00:00+00:00", 1704067200.0), ("2024-01-01 00:00:00", 1704067200.0),
     ("2024-01-01T00:00:00.500000Z", 1704067200.5), ("garbage", None), ("2024-01-01T00:00:00+02:00", None)],
)
def test_times(spark, text, want):
    assert one(spark, text, S.parse_time) == want


@pytest.mark.parametrize("days, want", [(365, "2024"), (30, "2024-12"), (7, "2024-W01"), (1, "2024-12-30")])
def test_buckets(spark, days, want):
    assert one(spark, 1735516800.0, lambda c: S.bucket(c, days), "double") == want
    assert one(spark, None, lambda c: S.bucket(c, days), "double") == "unknown"


def test_small_functions(spark):
    assert one(spark, "", S.sha256_hex) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, "a", S.seeded_uuid) == "0cc175b9-c0f1-b6a8-31c3-99e269772661"
    assert one(spark, " My: Title/ok? ", S.file_title) == "My_Titleok"
    assert one(spark, 1704067200.5, S.iso_micros, "double") == "2024-01-01T00:00:00.500000Z"


def node(text, parent, t, role="user", kids=()):
    return {"message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, "create_time": t, "metadata": {"model_slug": "m"}}, "parent": parent, "children": list(kids)}


EXPORT = {
    "conversation_id": "c1", "title": "T", "create_time": 1.0,
    "mapping": {"r": {"message": None, "parent": None, "children": ["b", "a"]}, "a": node("first", "r", 1.0, "tool"), "b": node("second", "r", 2.0, "assistant", ["d"]), "d": node(" ", "b", 3.0)},
}


def files(spark, *docs):
    return spark.createDataFrame([(p, d if isinstance(d, str) else json.dumps(d)) for p, d in docs], "path string, raw string")


def test_extract(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EXPORT))
    (tmp_path / "b.json").write_text(json.dumps([{k: v for k, v in EXPORT.items() if k != "conversation_id"} | {"id": "other"}]))
    (tmp_path / "bad.json").write_text("{nothing")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.json", json.dumps({"mapping": EXPORT["mapping"]}))
        z.writestr("skip.txt", "x")
    rows = I.extract(I.read_files(spark, str(tmp_path))).collect()
    assert {r.conversation_id for r in rows} == {"c1", "other"} and {r.text for r in rows} == {"first", "second", " "}
    assert {r.role for r in rows} == {"tool", "assistant", "user"}
    assert {r.conversation_id for r in I.extract(I.read_zips(spark, str(tmp_path / "z.zip"))).collect()} == {"one"}
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    assert I.read_zips(spark, str(tmp_path / "broken.zip")).count() == 0
    packed = K.to_zips(spark.createDataFrame([("a.json", json.dumps(EXPORT)), ("b.json", None)], "name string, raw string"))
    assert sorted((r.path, r.raw) for r in I.zip_members(packed).collect()) == [("a.zip!a.json", json.dumps(EXPORT)), ("b.zip!b.json", "")]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "n.md").write_text("# x")
    assert I.collect_files(spark, str(tmp_path)).count() == 4


def test_openai_order(spark):
    (c,) = I.parse(files(spark, ("x.json", EXPORT))).collect()
    assert [(m.role, m.content) for m in c.messages] == [("user", "first"), ("assistant", "second")] and c.created_at == 1.0


def test_other_formats(spark):
    anthropic = {"uuid": "u", "name": "N", "chat_messages": [{"sender": "human", "text": "hi", "created_at": "2024-01-01T00:00:00Z"}, {"sender": "assistant", "text": "", "content": [{"text": "x"}, {"text": "y"}]}]}
    array = [
        {"id": "1", "chatGroupId": "g", "role": "user", "model": "deepseek", "contents": [{"type": "text", "content": "q"}, {"type": "attachment", "attachment": {"name": "f.txt"}}], "created_at": "2024-01-02 00:00:00"},
        {"id": "2", "chatGroupId": "g", "role": "assistant", "model": "deepseek", "contents": [{"type": "thinking", "content": "a"}, {"type": "image", "content": "no"}], "created_at": "2024-01-01 00:00:00"},
        {"id": "3", "chatGroupId": "g", "role": "user", "model": "deepseek", "contents": []},
    ]
    md = "intro\n# Old\n# My chat\n#### You:\nhello\nthere\n#### ChatGPT:\n\nanswer\n#### Human:\n \n"
    got = {c.source_format: c for c in I.parse(files(spark, ("a.json", [anthropic]), ("d.json", array), ("m.md", md), ("s.json", {"exportDate": 1, "conversations": []}), ("u.json", "[]"), ("v.json", "nope"))).collect()}
    assert set(got) == {"anthropic", "deepseek", "openai_md"}
    assert [(m.role, m.content) for m in got["anthropic"].messages] == [("user", "hi"), ("assistant", "x\ny")]
    assert [m.content for m in got["deepseek"].messages] == ["q\n[Attachment: f.txt]", "a"]
    assert (got["deepseek"].created_at, got["deepseek"].updated_at) == (1704067200.0, 1704153600.0)
    assert got["openai_md"].title == "My chat" and [m.content for m in got["openai_md"].messages] == ["hello\nthere", "answer"]


@pytest.mark.parametrize("form", ["openai", "anthropic"])
def test_round_trip(spark, form):
    c = I.parse(files(spark, ("x.json", EXPORT)))
    docs = K.WRITERS[form](c).select(F.lit("y.json").alias("path"), F.col("doc").alias("raw"))
    (back,) = I.parse(docs).collect()
    assert [(m.role, m.content) for m in back.messages] == [("user", "first"), ("assistant", "second")] and (back.id, back.title) == ("c1", "T")


def test_dedup_conversations(spark):
    twice = I.parse(files(spark, ("x.json", [EXPORT, EXPORT | {"conversation_id": "c0"}, EXPORT | {"title": "other"}])))
    assert sorted(r.id for r in I.dedup_conversations(twice).collect()) == ["c0", "c1"]


def test_split(spark, tmp_path):
    named = K.write_split(I.parse(files(spark, ("x.json", EXPORT))), str(tmp_path / "out")).collect()
    assert [n.file_name[:2] for n in named] == ["T_"] and spark.read.text(str(tmp_path / "out")).count() == 1


def test_gexf(spark, tmp_path):
    g = graph(
        spark, [("c", "Conversation"), msg(1, 'say "<hi>" & \x01'), ("a", "Entity", "", "", "A", "T"), ("b", "Entity", "", "", "B", "T"), ("k", "Keyword", "", "", "K", "")],
        contains=[("c", "msg::1"), ("c", "gone")], mentions=[("msg::1", "a"), ("msg::1", "b")], cooc=[("a", "b", 2)], keywords=[("msg::1", "k", 0.5)],
    )
    K.write_gexf(g, str(tmp_path / "g"))
    text = "\n".join((p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))))
    root = ET.fromstring(text.strip().encode())
    ns = {"g": "http://gexf.net/1.3"}
    assert len(root.findall(".//g:node", ns)) == 5 and len(root.findall(".//g:edge", ns)) == 6
    K.write_bulk(g, str(tmp_path / "bulk"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bulk/edges/cooc")).count() == 1
    assert json.loads({r.id: r.attrs for r in K.graph_dict(g).collect()}["a"]) == {"label": "Entity", "name": "A", "entity_type": "T"}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = {"id": "m1", "role": "user", "text": "see Alice", "conversation_id": "c", "lang": "en"}
    (source / "1.json").write_text(json.dumps(row))
    N.watch(spark, str(source), str(tmp_path / "g"), str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text(json.dumps(row | {"id": "m2", "parent": "m1"}) + "\n" + json.dumps(row))
    N.watch(spark, str(source), str(tmp_path / "g"), str(tmp_path / "ck")).awaitTermination()
    from threadloom.graph import Graph

    g = Graph.read(spark, str(tmp_path / "g/v1"))
    assert g.of("Message").count() == 2 and g.mentions.count() == 2 and g.replies.count() == 1
    (tmp_path / "ev").mkdir()
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a", "t"), ("2024-01-01 02:00:00", "a", "t"), ("2024-01-02 02:00:00", "b", "u")], "t string, event_type string, text string").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "ev/x"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev/x"))
    q = N.windowed_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    q = N.distinct_texts(live).writeStream.format("memory").queryName("texts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("texts").count() == 2

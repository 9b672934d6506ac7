"""Archives against their contract, written and read back; coalesced ranges; lost tasks; foreign archives."""

import base64
import gzip
import hashlib
import os
from collections import defaultdict

import pytest

from threadloom.llm import ORACLES, QUERIES, warc

BIG = "<p>é 日本 " + "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n</p>"
PAGES = [
    (1, "http://a.example/", "<p>one</p>"), (2, "http://b.example/?q=a b", "<p>two</p>"), (3, "http://c.example/\r\nX: y", "<p>one</p>"), (4, None, None), (5, "http://e.example/", ""),
    (6, "http://f.example/é", BIG), (7, "http://g.example/", BIG), (None, "http://h.example/", "<p>two</p>"), (None, None, "only null"), (None, "x", "only null"),
    (3, "http://c.example/again", "<p>one</p>"), (-9, "http://z.example/", "\x00 HTTP/1.1 200 OK\r\n\r\n"), *[(100 + i, f"http://m.example/{i}", f"page {i % 40}") for i in range(200)],
]
SCHEMA = "page_id long, url string, html string, id string, payload string, refers_to string, sha string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "p", "r", "s", 1) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    top = {}
    for key, _, html in rows:
        h = html or ""
        top[h] = max((k for k in (top.get(h), key) if k is not None), default=None)
    out = []
    for key, url, html in rows:
        h = html or ""
        same = top[h] == key
        out.append((key, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if same else "revisit", None if same else top[h]))
    return sorted(out, key=repr)


def test_query_and_its_sql(spark, tmp_path):
    import duckdb

    frame(spark, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r)[:5] for r in QUERIES["op11_warc"](spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(PAGES)
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted((r[:5] for r in duck.sql(ORACLES["op11_warc"]).fetchall()), key=repr) == got


def test_empty_table(spark, tmp_path):
    index = warc.write_archives(warc.with_originals(frame(spark, [])), str(tmp_path))
    assert index.count() == 0 and warc.read_records(index, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [1 << 30, 2000])
def test_selected_records_come_back_whole(spark, tmp_path, most):
    index = warc.write_archives(warc.with_originals(frame(spark, PAGES)), str(tmp_path), most)
    assert (index.select("file").distinct().count() > 5) == (most < 1 << 30)
    some = index.where("record_type = 'response' and url like '%m.example%' or id in ('6', '7', '-9')")
    got = {r.id: r for r in warc.read_records(some, str(tmp_path)).collect()}
    pages = {str(k): h for k, _, h in PAGES}
    assert len(got) == 43 and all(bytes(r.payload).decode() == pages[i] for i, r in got.items() if r.record_type == "response")
    assert got["6"].refers_to == "7" and got["6"].payload is None and got["6"].payload_bytes == len(BIG.encode())


def test_short_payloads_are_all_responses(spark, tmp_path):
    rows = warc.with_originals(frame(spark, PAGES), 11).collect()
    assert {r.id for r in rows if r.refers_to} == {"6"}


def test_index_of_a_foreign_archive(spark, tmp_path):
    """Archives tell their own index; one that nobody committed is seen by it, and not by the writer's index."""
    index = warc.write_archives(warc.with_originals(frame(spark, PAGES)), str(tmp_path), 5000)
    columns = ["file", "offset", "length", "id", "record_type", "payload_digest"]
    want = sorted(map(tuple, index.select(*columns).collect()), key=repr)
    assert sorted(map(tuple, warc.index_archives(spark, str(tmp_path)).select(*columns).collect()), key=repr) == want
    member, _ = warc.record("77", "http://lost.example/", b"half a task", None)
    with open(f"{tmp_path}/lost.warc.gz", "wb") as f:
        f.write(member)
    assert warc.read_records(index, str(tmp_path)).where("id = '77'").count() == 0
    again = warc.index_archives(spark, str(tmp_path))
    assert again.count() == len(want) + 1 and warc.read_records(again.where("id = '77'"), str(tmp_path)).first().payload == b"half a task"


def test_archives_are_gzip_members(spark, tmp_path):
    warc.write_archives(warc.with_originals(frame(spark, PAGES[:3])), str(tmp_path))
    text = b"".join(gzip.open(f"{tmp_path}/{f}").read() for f in os.listdir(tmp_path) if f.endswith(".warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 3 + text.count(b"WARC-Type: warcinfo") and b"\r\nX: y" not in text


def test_changed_payload_is_an_error():
    member, _ = warc.record("1", None, b"payload", None)
    assert warc.parsed(member)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(gzip.compress(gzip.decompress(member).replace(b"payload\r\n", b"pAyload\r\n")))


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("a", 111, 200), ("b", 311, 5)]
    got = list(warc.ranges(iter(rows), gap=5, span=60))
    assert [(f, s, e, len(m)) for f, s, e, m in got] == [("a", 0, 30, 3), ("a", 100, 110, 1), ("a", 111, 311, 1), ("b", 311, 316, 1)]
    read = defaultdict(int)
    for f, s, e, m in warc.ranges(iter(rows), gap=1000, span=10_000):
        read[f] += 1
        assert all(s <= o and o + n <= e for o, n in m)
    assert read == {"a": 1, "b": 1}

"""Exports read by byte ranges give what the whole files give, wherever they are cut."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import exports as I
from threadloom.sources import splits


def node(role, text, parent, children, at):
    return {"message": {"author": {"role": role}, "create_time": at, "content": {"content_type": "text", "parts": [text]}}, "parent": parent, "children": children}


NASTY = ['say "hi", {not} [a] list', "back\\slash \\\\", 'ends with a quote"', "\\", '\\"', "é 日本 }{][,", "", "  \t\n", "x" * 300]
EXPORT = [
    {"conversation_id": f"c{i}", "title": NASTY[i % len(NASTY)], "create_time": 1.5e9 + i, "mapping": {f"r{i}": node("user", t, None, [f"s{i}"], 1.0), f"s{i}": node("assistant", t[::-1], f"r{i}", [], 2.0)}}
    for i, t in enumerate(NASTY * 2)
]
ANTHROPIC = [{"uuid": f"u{i}", "name": t, "chat_messages": [{"sender": "human", "text": t, "created_at": "2024-01-01T00:00:00Z"}]} for i, t in enumerate(NASTY)]
ARRAY = [{"id": f"m{i}", "role": "user", "model": "gemini", "chatGroupId": f"g{i % 3}", "contents": [{"type": "text", "content": t}], "created_at": "2024-01-01T00:00:00Z"} for i, t in enumerate(NASTY)]


def plain(text):
    """The elements of a list, or the object; nothing for anything else."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    return list(enumerate(data)) if isinstance(data, list) else [(0, data)] if isinstance(data, dict) else []


CASES = [
    json.dumps(EXPORT[:4]), json.dumps(EXPORT[:3], ensure_ascii=False, indent=1), "[]", " [ ] ", "{}", "[1, null, \"a,b\", [2, {\"k\": [3]}], {\"x\": \"}\"}]", json.dumps(EXPORT[1]),
    ' \n {"a": {"b": [1, 2]}, "c": "\\\\"} \n', '["\\\\", "\\\\\\"", "\\\\\\\\", ","]',
]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_every_cut_of_a_file(text, block, tmp_path):
    """Two ranges that meet at every byte, blocks of every size: every value comes once, from one of them."""
    path = tmp_path / "x.json"
    data = text.encode()
    path.write_bytes(data)
    source, want = splits.Source(f"file://{path}"), plain(text)
    listed = text.lstrip().startswith("[")
    steps = range(0, len(data) + 1, 1 if block > 3 and len(data) < 200 else 37)
    for cut in steps:
        got = []
        for start, end in ((0, cut), (cut, len(data))):
            state = state_at(data, start)
            got += [(p, json.loads(t)) for p, t in splits.elements_from(source, start, end, len(data), *state, listed, block) if t.strip()]
        assert got == want, cut


def state_at(data, end):
    """Inside a string, depth, and elements before, read byte by byte."""
    inside = escaped = False
    depth = pos = 0
    for c in data[:end]:
        c = chr(c)
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
            pos += c == "," and depth == 1
    return inside, depth, pos


@pytest.mark.parametrize("size,block", [(1, 2), (7, 3), (100, 64), (1 << 25, 1 << 22)])
def test_states_and_elements(spark, tmp_path, size, block):
    texts = {f"f{i}.json": t for i, t in enumerate(CASES if size > 1 else CASES[2:])} | {"cut.json": json.dumps(EXPORT)[:-40], "blank.json": "  \n", "word.json": '"only"', "empty.json": ""}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, encoding="utf-8")
    ranges = splits.byte_ranges(spark, str(tmp_path), size=size)
    for r in splits.located(ranges, block).collect():
        assert (r.inside, r.depth, r.pos) == state_at(texts[r.path.rsplit("/", 1)[1]].encode(), r.start) or not r.listed
    got = {}
    for r in splits.read_elements(spark, str(tmp_path), size=size, block=block).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.pos, json.loads(r.raw)))
    want = {name: plain(t) for name, t in texts.items()}
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: v for k, v in want.items() if v and k != "word.json"}


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_parsers_give_the_same(spark, tmp_path, size):
    docs = {"a.json": EXPORT, "b.json": EXPORT[3], "c.json": ANTHROPIC, "d.json": ANTHROPIC[1], "e.json": ARRAY, "s.json": {"exportDate": 1, "conversations": []}, "u.json": []}
    for name, d in docs.items():
        (tmp_path / name).write_text(json.dumps(d), encoding="utf-8")
    whole = I.read_files(spark, str(tmp_path))
    columns = ["id", "title", "messages", "created_at", "updated_at", "model", "source_format"]
    want = I.parse(whole).select(*columns)
    got = splits.parse_exports(spark, str(tmp_path), size=size, block=64)
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.collect())) and want.count() > 20
    kept = ["id", "role", "text", "parent", "conversation_id"]
    a, b = I.extract(whole).select(*kept), I.extract(splits.read_elements(spark, str(tmp_path), size=size, block=64)).select(*kept)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() > 20


def test_markdown_of_many_lines(spark):
    """Work in proportion to the lines of a message."""
    text = "# Long\nlost line\n#### You:\n" + "\n".join(f"line {i}" for i in range(20_000)) + "\n#### ChatGPT:\n\nshort\n# Later\n"
    (c,) = I.parse_markdown(spark.createDataFrame([("x.md", text)], "path string, raw string")).collect()
    assert c.title == "Later" and [m.role for m in c.messages] == ["user", "assistant"] and c.messages[0].content.count("\n") == 19_999


def test_formats_are_told_from_the_first_value(spark, tmp_path):
    for name, d in {"a.json": EXPORT, "b.json": EXPORT[0], "c.json": ANTHROPIC, "e.json": ARRAY}.items():
        (tmp_path / name).write_text(json.dumps(d), encoding="utf-8")
    state = splits.with_formats(splits.located(splits.byte_ranges(spark, str(tmp_path), size=40), 16), 16)
    got = {r.p: r.f for r in state.select(F.element_at(F.split("path", "/"), -1).alias("p"), F.col("format").alias("f")).distinct().collect()}
    assert got == {"a.json": "openai_master", "b.json": "openai_individual", "c.json": "anthropic_master", "e.json": "gemini"}

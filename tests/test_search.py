"""The substring index against a scan, and streamed replies against a batch build."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import substring_index as I
from threadloom.streaming.replies import collect_edges


def scan(rows, terms):
    return sorted((t, i, x.lower().find(t.lower()) + 1) for t in terms if t for i, x in rows if x and i is not None and t.lower() in x.lower())


def asked(spark, rows, terms, path, block):
    texts = spark.createDataFrame([(i, x, "other", 1) for i, x in rows], "id long, text string, gram string, n long")
    I.write_index(texts, path, block)
    index = I.read_index(spark, path)
    return index, sorted(map(tuple, I.search(index, texts, terms).collect()))


@pytest.mark.parametrize("block", [2, 1 << 14])
def test_index_gives_the_rows_of_a_scan(spark, tmp_path, block):
    rng = random.Random(5)
    letters = "abcAB äß€\U0001f600%_\\"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for k in range(120)]
    rows += [(200, None), (201, ""), (None, "abc"), (7, "abcabc"), (7, "abcabc"), (202, "x" * 70000 + "needle" + "y" * 70000), (203, "a\x00b")]
    terms = ["a", "B", "ab", "\U0001f600", "€%", "abc", "Bab", "_", "\\", "xne", "EEDLEY", "nothing", "", "aaaaaaaa", "\x00"]
    index, got = asked(spark, rows, terms, str(tmp_path / "index"), block)
    assert got == scan(rows, terms)
    assert index.where("n <> size(ids)").isEmpty() and index.groupBy("gram", "part").count().where("count > 1").isEmpty()
    assert (index.agg(F.max("part")).first()[0] > 0) == (block == 2)


def test_index_of_nothing(spark, tmp_path):
    assert asked(spark, [], ["a", "abc"], str(tmp_path / "index"), 4)[1] == []
    assert asked(spark, [(1, "abc")], [], str(tmp_path / "index2"), 4)[1] == []


def test_index_reads_few_lists(spark, tmp_path):
    """The filter on grams reaches the files, and only the rarest grams of a term are asked for."""
    rows = [(k, f"common words in every text {'rare gem' if k % 50 == 0 else ''}") for k in range(500)]
    index, got = asked(spark, rows, ["common words rare", "text rare gem"], str(tmp_path / "index"), 64)
    assert got == scan(rows, ["common words rare", "text rare gem"])
    found = I.candidates(index, ["text rare gem"])
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan
    assert found.count() == 10


def batch_edges(rows):
    known = {i for i, _ in rows if i is not None}
    return sorted({(p, i) for i, p in rows if i is not None and p in known})


@pytest.mark.parametrize("order", ["children first", "parents first", "mixed"])
def test_replies_in_any_order(spark, tmp_path, order):
    rows = [("root", None)] + [(f"m{k}", "root" if k < 40 else f"m{k // 3}") for k in range(1, 90)] + [("self", "self"), ("lost", "nowhere"), (None, "root")]
    if order == "children first":
        rows = rows[::-1]
    elif order == "mixed":
        random.Random(3).shuffle(rows)
    third = -(-len(rows) // 3)
    for k in range(3):  # files of one folder are taken in the order of their times
        part = spark.createDataFrame(rows[k * third : (k + 1) * third], "id string, parent string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    made = collect_edges(str(tmp_path / "in"), source, str(tmp_path / "out"), str(tmp_path / "state"), spread=3)
    assert sorted(map(tuple, made.collect())) == batch_edges(rows)


def test_replies_go_on_after_a_restart(spark, tmp_path):
    """State outlives the query: a parent that comes in a later run meets the child that waited."""
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    for rows in ([("b", "a"), ("c", "b")], [("a", None)]):
        spark.createDataFrame(rows, "id string, parent string").coalesce(1).write.mode("append").parquet(where[0])
        made = collect_edges(where[0], spark.read.parquet(where[0]), where[1], where[2], spread=2)
    assert sorted(map(tuple, made.collect())) == [("a", "b"), ("b", "c")]


def test_a_child_is_forgotten_after_its_time():
    """The state step alone, with a state of its own."""
    import pandas as pd

    from threadloom.streaming.replies import _step

    class State:
        exists, hasTimedOut, get, after = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, ms):
            self.after = ms

    def fed(state, *children):
        return [tuple(r) for out in _step(50)(("p", 0), iter([pd.DataFrame({"child": list(children)}, dtype="object")]), state) for r in out.itertuples(index=False)]

    state = State()
    assert fed(state, "c", "c") == [] and state.get == (False, ["c"]) and state.after == 50
    state.hasTimedOut = True
    assert fed(state) == [] and not state.exists
    state.hasTimedOut = False
    assert fed(state, None) == [] and fed(state, "late") == [("p", "late")]

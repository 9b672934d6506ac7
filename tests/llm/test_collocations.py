"""Collocations against counting every phrase of every piece."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.llm import ORACLES, QUERIES, collocations

FIXED = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least=30, longest=4, inside=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FIXED)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    cand = {p: c for p, c in often.items() if len(p[1]) > 1}
    gone = set()
    for (lang, w), c in cand.items():
        for m in range(2, len(w)):
            gone |= {(lang, x) for x in (w[i : i + m] for i in range(len(w) - m + 1)) if 100 * c >= inside * often[lang, x]}
    out = []
    for lang in {x for x, _ in cand}:
        mine = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                score, _, left, right = min((2000000 * a // (often[g, w[:k]] + often[g, w[k:]]), k, often[g, w[:k]], often[g, w[k:]]) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, k, w.decode(), -a, left, right, n[lang], -s) for k, (s, a, w, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def texts(seed, docs=60):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "and", "é", "日本", "a\x00b", "x\x1cy", "\x85", *[f"w{i}" for i in range(30)]]
    pick = lambda: vocab[min(int(rng.expovariate(0.25)), len(vocab) - 1)]
    stock = ["as a matter of fact", "in spite of it", "once upon a time there", "New York"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(stock) if rng.random() < 0.3 else pick() + rng.choice(["", "", "", ".", ",", "\n", "\t", "  ", ";x", "\x0b"]))
        out.append((i, " ".join(words), rng.choice(["en", "en", "de", None])))
    return out + [(None, None, "en"), (1, "", None), out[0], (5, "Same Line here\n" * 50, "en"), (6, "hot hot " * 300, "fr")]


SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("tuning", [{}, {"hot": 20, "group": 10, "slack": 0, "block": 400, "chunk": 50}, {"hot": 500, "group": 3, "slack": 1, "block": 50, "chunk": 5}])
@pytest.mark.parametrize("least,inside,top", [(30, 80, 2000), (2, 80, 25), (5, 100, 2000)])
def test_against_all_phrases(spark, tuning, least, inside, top):
    """Small limits make prefixes hot up to whole phrases, blocks and slices many, and groups larger than a chunk."""
    rows = texts(len(tuning))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = collocations.collocations(df, least=least, inside=inside, top=top, **tuning)
    want = plain([r[1:] for r in rows], least, inside=inside, top=top)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 3


def test_long_text_is_read_in_slices(spark, monkeypatch):
    rows = [(1, "one two three. " * 20_000 + "end " * 10, "en")]
    parts = list(collocations.slices(rows[0][1].encode()))
    assert [w for p in parts for w in p if w != b"\xff"] == [w.strip(".").encode() for w in rows[0][1].split()]
    monkeypatch.setattr(collocations, "SLICE", 1000)
    assert len(list(collocations.slices(rows[0][1].encode()))) > 200
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA), block=5000).collect()
    assert sorted(map(tuple, out)) == plain([r[1:] for r in rows])


def test_many_languages_in_small_parts(spark):
    """All languages together fill the blocks, and the pointers of a prefix leave in several batches."""
    rows = [(i, r[1], f"l{i % 30}") for i, r in enumerate(texts(7, 300))]
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(2), least=3, block=40, part=7, chunk=20)
    want = plain([r[1:] for r in rows], least=3)
    assert sorted(map(tuple, out.collect())) == want and len({r[0] for r in want}) > 20


TASK = """
import random
import pyarrow as pa
from threadloom.llm import collocations as c

class Known:
    value = {}

def held(what):
    return int(next(x for x in open("/proc/self/status") if x.startswith(what)).split()[1]) / 1024

def batches(n):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(50_000)]
    for _ in range(n):
        text = " ".join(words[min(int(rng.paretovariate(0.6)), 49_999)] for _ in range(100_000))
        yield pa.record_batch([["en"], [text]], ["lang", "text"])

small, before, most = list(batches(1)), held("VmRSS:"), 0
for f in (c._count(c.LONGEST, c.HOT, c.SLACK, c.BLOCK), c._project(c.LONGEST, c.BLOCK, Known)):
    for out in f(batches(25)):
        most = max(most, out.nbytes)
print(held("VmHWM:") - before, most / 1e6)
"""


def test_memory_of_a_task():
    """Two and a half million words of one language: memory is that of a block, and no batch is large."""
    mb, most = map(float, subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, check=True, cwd=Path(collocations.__file__).parents[2]).stdout.split())
    assert mb < 200 and most < 8, (mb, most)


def test_large_numbers_are_exact(spark):
    """Scores are divided as whole numbers beyond 64 bits."""
    big = 2**62
    df = spark.createDataFrame([(big, big + 1, big + 5)], "a long, l1 long, r1 long")
    score = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l1 as decimal(20,0)) + cast(r1 as decimal(20,0)))"
    assert df.select(F.expr(score)).first()[0] == 2000000 * big // (2 * big + 6)


def test_query_and_its_sql(spark, docs, rows, nothing, tmp_path):
    """The registered query on odd rows (nulls, clashing names, long texts) and its SQL."""
    import duckdb

    more = [(5000 + i, f"Once upon a time, {i} frogs; once upon a time there", "en" if i % 3 else None, *rows[0][3:]) for i in range(70)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_collocations"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert got == plain([(r[1], r[2]) for r in [*rows, *more]]) and got
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.sql(ORACLES["op13_collocations"]).fetchall()) == got
    assert collocations.collocations(nothing).count() == 0

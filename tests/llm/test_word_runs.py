"""Runs of words against all periods of all places, one text at a time."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from threadloom.llm import QUERIES, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(t, least=12):
    """Every maximal stretch of every period, kept where no smaller period holds."""
    n, out = len(t), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and t[i] == t[i + q]:
                i += 1
            size = i + q - a
            w = t[a : a + size]
            if size >= max(least, 2 * q) and not any(w[d:] == w[: size - d] for d in range(1, q)):
                out.append((a, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapsed(w, runs)),
    )


@pytest.mark.parametrize("least", [2, 5, 8, 12])
def test_all_runs_are_found(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 40])
            t = [rng.randint(1, k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, n)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        got = word_runs.find_runs([np.array(t, np.int64) for t in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least) for t in texts]


@pytest.mark.parametrize("values", [range(900), range(900, 0, -1), [-5000, *range(900, 0, -1)], [-5000, *range(900, 0, -1), *range(40)], []])
def test_next_smaller(values):
    v = list(values)
    want = [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]
    assert word_runs.next_smaller(np.array(v, np.int64)).tolist() == want


def test_minima_of_every_range():
    v = np.random.default_rng(3).integers(0, 50, 300)
    lo, hi = np.array([(a, b) for a in range(300) for b in range(a, 300)]).T
    assert word_runs.Minima(v).over(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]


def test_long_texts():
    """A Fibonacci word has the most runs; one word over and over has one; many words at random have none."""
    a, b = [1], [1, 2]
    while len(b) < 3000:
        a, b = b, b + a
    assert [tuple(r) for r in word_runs.find_runs([np.array(b)])[0].tolist()] == plain_runs(b)
    assert word_runs.find_runs([np.ones(200_000, np.int64)])[0].tolist() == [[0, 200_000, 1]]
    assert not len(word_runs.find_runs([np.random.default_rng(1).integers(1, 10**6, 200_000)])[0])


def test_query(spark, docs, rows, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows, and documents whose words are repeated by the query."""
    more = [(1000 + i, rows[-1][1], *rows[-1][2:]) for i in range(60)]
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in more)
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_word_runs"](spark, str(tmp_path))
    got = [tuple(r)[:8] for r in out.collect()]
    want = [expected(r[0], r[1]) for r in [*rows, *more]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[1] for w in want) > 5
    assert word_runs.word_runs(nothing).count() == 0


def test_collapsed_text(spark):
    text = "so " + "it goes on " * 6 + "until the end"
    r = word_runs.word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(1, 18, 3)] and r.collapsed == "so it goes on until the end"

"""Periodic runs of words: the runs theorem on whole texts, many texts at a time.

A run is a maximal stretch of words with smallest period q that is at least 2q long. By the runs theorem every run holds a
*Lyndon root*: for one of the two orders of the words (an order and its reverse) the longest Lyndon word that starts at
some place of the run has the length q. So the candidates are two per word, and they are exact:

1. A suffix array by prefix doubling; only suffixes that are still equal are sorted again.
2. The longest Lyndon word at i ends before the next smaller value of the inverse suffix array, under the reversed order
   before the next greater one (the end of a text is the smallest word of one order and the greatest of the other).
3. A root [i, j) is extended to the right by the longest common extension of i and j, which is a range minimum of the LCP
   array (sparse tables: six fine levels, and coarse ones over blocks of 32), and to the left by the same on the
   reversed texts. Stretches of at least ``max(least, 2q)`` words stay; equal ones are one run.

Texts lie one behind the other in one array with an end mark after each; suffixes are ranked within their text. A run of
``least`` = 12 words repeats its first six words, so texts without a repeated sequence of four words are done after two
doublings. Everything is exact for every order of the words, so their dictionary numbers are taken.

A text is worked on whole by one task, in memory of some 300 bytes a word; short texts share one pass of ``BATCH`` words.
Nothing is shuffled. Defined results: a null text is empty (no words, no runs, an empty collapsed text); a null doc_id is carried;
repeated rows stay; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import let, table, words_of

#: Shortest run that counts, in words.
LEAST = 12
#: Words that one pass over short texts takes.
BATCH = 1 << 18
#: Pairs of words that one step of a comparison looks at.
_LOOK = 1 << 20
_FINE = 5


def suffix_ranks(key: np.ndarray, until: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks, and places in the suffix array that are not settled yet, by prefix doubling over ``key``.

    Keys order the texts first and the words within; the end mark of a text is unique in it, so a suffix whose known
    prefix reaches the mark is settled and no comparison leaves its text. ``until`` stops when so many words are compared.
    """
    n = len(key)
    sa = np.argsort(key)
    at, known = np.arange(n), 1
    rank = np.empty(n, np.int64)
    fresh, slots = key[sa], sa
    while True:
        new = np.ones(len(at), bool)
        np.not_equal(fresh[1:], fresh[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=len(at))
        rank[slots] = np.repeat(at[heads], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at) or (until and known >= until):
            return sa, rank, at
        slots = sa[at]
        fresh = rank[slots] * n + rank[slots + known]
        order = np.argsort(fresh)
        fresh, slots = fresh[order], slots[order]
        sa[at] = slots
        known *= 2


def matching(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b`` (different places of one text)."""
    out, live, width, last = np.zeros(len(a), np.int64), np.arange(len(a)), 1, len(s) - 1
    while len(live):
        width = max(1, min(width, _LOOK // len(live)))
        ahead = out[live][:, None] + np.arange(width)
        same = s[np.minimum(a[live][:, None] + ahead, last)] == s[np.minimum(b[live][:, None] + ahead, last)]
        whole = same.all(1)
        out[live] += np.where(whole, width, same.argmin(1))
        live = live[whole]
        width *= 2
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray, text: np.ndarray) -> np.ndarray:
    """LCP of every suffix with the one before it in the suffix array; 0 for the first of a text.

    Only irreducible places (whose neighbours to the left differ) are compared; their lengths sum to at most 2 n log n.
    The others are one less than the place to their left.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    inside = (before >= 0) & (text[before] == text)
    left = np.concatenate(([0], s[:-1]))
    own = ~inside | (left == 0) | (left != left[before])
    asked = np.flatnonzero(own & inside)
    found = np.zeros(n, np.int64)
    found[asked] = matching(s, asked, before[asked])
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return (found[source] - (np.arange(n) - source))[sa]


class Minima:
    """Minima of ranges by sparse tables: windows of up to 32 at every place, and whole blocks of 32 beyond."""

    def __init__(self, values: np.ndarray) -> None:
        self.fine = [values.astype(np.int32)]
        for k in range(_FINE):
            v = self.fine[-1]
            self.fine.append(np.minimum(v[: -(1 << k)], v[1 << k :]) if len(v) > 1 << k else v)
        size = 1 << _FINE
        whole = values[: len(values) // size * size].astype(np.int32).reshape(-1, size).min(1)
        self.coarse = [whole]
        while len(self.coarse[-1]) > 1 << (len(self.coarse) - 1):
            v, w = self.coarse[-1], 1 << (len(self.coarse) - 1)
            self.coarse.append(np.minimum(v[:-w], v[w:]))

    @staticmethod
    def _windows(tables: list[np.ndarray], lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, level = np.empty(len(lo), np.int32), np.frexp(size.astype(float))[1] - 1
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            out[m] = np.minimum(tables[k][lo[m]], tables[k][lo[m] + size[m] - (1 << int(k))])
        return out

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of ``values[lo : hi + 1]``."""
        size, out, block = hi - lo + 1, np.empty(len(lo), np.int64), 1 << _FINE
        near = np.flatnonzero(size < 2 * block)
        out[near] = self._windows(self.fine, lo[near], size[near])
        far = np.flatnonzero(size >= 2 * block)
        if len(far):
            a, b = lo[far], hi[far]
            first, end = -(-a // block), (b + 1) // block
            edge = np.minimum(self.fine[_FINE][a], self.fine[_FINE][b - block + 1])
            out[far] = np.minimum(edge, self._windows(self.coarse, first, end - first))
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value; the length of ``values`` where there is none.

    Places jump over what their candidate has jumped over; the few that need many jumps descend a tree of minima.
    """
    n = len(values)
    v = np.append(values, values.min(initial=0) - 1)
    to = np.arange(1, n + 1)
    live = np.flatnonzero(v[to] > values)
    for _ in range(8):
        to[live] = to[to[live]]
        live = live[v[to[live]] > values[live]]
    if not len(live):
        return to
    levels = [v]
    while len(levels[-1]) > 1:
        w = levels[-1]
        w = np.append(w, np.iinfo(w.dtype).max) if len(w) % 2 else w
        levels[-1] = w
        levels.append(np.minimum(w[::2], w[1::2]))
    asked, at = values[live], to[live]
    level, node, open_ = np.zeros(len(live), np.int64), at.copy(), np.ones(len(live), bool)
    for k in range(len(levels)):  # up: a node to the right is looked at where it is a right child
        look = np.flatnonzero(open_ & ((node & 1 == 1) | (k == len(levels) - 1)))
        hit = levels[k][node[look]] < asked[look]
        level[look[hit]], open_[look[hit]] = k, False
        node[look[~hit]] += 1
        node[open_] >>= 1
    for k in range(len(levels) - 1, 0, -1):  # down to the first smaller one
        down = np.flatnonzero(level >= k)
        node[down] *= 2
        node[down] += levels[k - 1][node[down]] >= asked[down]
    to[live] = node
    return to


class Extensions:
    """Longest common extensions to the right, from suffix array, LCP and range minima."""

    def __init__(self, s: np.ndarray, text: np.ndarray) -> None:
        self.s, self.text = s, text
        self.sa, self.rank, _ = suffix_ranks(text * (int(s.max(initial=0)) + 1) + s)
        self.minima: Minima | None = None

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.minima is None:
            self.minima = Minima(common_prefixes(self.s, self.sa, self.text))
        x, y = self.rank[a], self.rank[b]
        return self.minima.over(np.minimum(x, y) + 1, np.maximum(x, y))


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts (numbers from 1) between end marks of 0, and the number of the text of each place."""
    mark = np.zeros(1, np.int64)
    s = np.concatenate([mark] + [x for t in texts for x in (t, mark)])
    ends = s == 0
    return s, np.cumsum(ends) - ends


def find_runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Per text (numbers from 1) its runs as rows (start, length, period), by start, then period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    may = list(range(len(texts)))
    if least >= 8:  # a run repeats at least half of its words, so four in a row
        s, text = _laid_out(texts)
        sa, _, at = suffix_ranks(text * (int(s.max(initial=0)) + 1) + s, 4)
        may = (np.unique(text[sa[at]]) - 1).tolist()
    if not may:
        return out
    s, text = _laid_out([texts[k] for k in may])
    n = len(s)
    ahead = Extensions(s, text)
    places = np.flatnonzero(s)
    i, j = [], []
    for values in (ahead.rank, -ahead.rank):
        to = next_smaller(values)[places]
        ok = to < n
        a, b = places[ok], to[ok]
        ok = (s[b] > 0) & (text[a] == text[b])
        a, b = a[ok], b[ok]
        ok = (s[a] == s[b]) | ((s[a - 1] == s[b - 1]) & (s[a - 1] > 0))  # one word of extension at least
        i.append(a[ok])
        j.append(b[ok])
    i, j = np.concatenate(i), np.concatenate(j)
    period = j - i
    right = np.zeros(len(i), np.int64)
    ask = np.flatnonzero(s[i] == s[j])
    right[ask] = ahead.of(i[ask], j[ask])
    # the word that far to the left must be equal too; most candidates end here, before the reversed texts are ranked
    need = np.maximum(least, 2 * period) - period - right
    far = np.maximum(i - np.maximum(need, 0), 0)
    ok = (need <= 0) | ((text[far] == text[i]) & (s[far] > 0) & (s[far] == s[far + period]))
    i, j, period, right = i[ok], j[ok], period[ok], right[ok]
    left = np.zeros(len(i), np.int64)
    ask = np.flatnonzero((s[i - 1] > 0) & (s[i - 1] == s[j - 1]))
    if len(ask):
        del ahead
        turned = s[::-1].copy()
        ends = turned == 0
        back = Extensions(turned, np.cumsum(ends) - ends)
        left[ask] = back.of(n - i[ask], n - j[ask])
    length = period + left + right
    ok = length >= np.maximum(least, 2 * period)
    start = (i - left)[ok]
    rows = np.unique(np.stack([start, period[ok], length[ok]], 1), axis=0)
    begins = np.flatnonzero(s == 0)[:-1] + 1
    owner = text[rows[:, 0]] - 1
    bounds = np.searchsorted(owner, np.arange(len(may) + 1))
    for k, d in enumerate(may):
        part = rows[bounds[k] : bounds[k + 1]]
        if len(part):
            out[d] = np.stack([part[:, 0] - begins[k], part[:, 2], part[:, 1]], 1)
    return out


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _kernel(least: int):
    def part(cut: list[list[bytes]]) -> Iterator[tuple[int, list[dict], bytes]]:
        sizes = [len(w) for w in cut]
        flat = pa.array([w for words in cut for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        found = find_runs(np.split(flat, np.cumsum(sizes)[:-1]), least)
        for words, runs in zip(cut, found):
            kept = compress(words, ~dropped(len(words), runs)) if len(runs) else words
            yield len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()], b" ".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, first, cut, held = b.column(1).cast(pa.binary()), 0, [], 0
            for at in range(b.num_rows):
                cut.append((texts[at].as_py() or b"").split())
                held += len(cut[-1])
                if held >= BATCH or at == b.num_rows - 1:
                    rows = list(part(cut))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(first, len(cut)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _RUNS),
                            pa.array([r[2] for r in rows], pa.binary()).view(pa.string()),
                        ],
                        ["doc_id", "n_words", "runs", "collapsed"],
                    )
                    first, cut, held = at + 1, [], 0

    return run


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, its runs by start and period, and the text without repetitions."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _kernel(least), f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def repeated(doc_id: Column, text: Column) -> Column:
    """The text that the query looks at: one document in ten repeats a stretch of its words from some place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "),
        )

    return F.when(h % 10 == 0, let(words_of(text), lambda w: F.when(F.size(w) == 0, F.lit("")).otherwise(turned(w)))).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text.

    A null doc_id has no number, so its text stays as it is.
    """
    docs = table(spark, sf_dir, "documents")
    found = word_runs(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("*", top.alias("top")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.expr("-1000 * top.l div top.p").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )

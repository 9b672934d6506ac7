"""License scans: matching statistics of a text against a generalised suffix automaton of license templates.

The automaton holds all word sequences of all templates and is built once per worker; its size depends on the templates
alone. A text is streamed through it word by word, which gives at every word the longest template passage that ends
there. Maximal passages of ``SEED`` words or more are chained per template (in order in both, gaps of at most ``GAP``
words); a chain that covers ``COVER`` of its template is a span. Spans of one template do not overlap: of those that do,
the one that covers most stays, of equal ones the first. A span adds its template's label; ``score`` is the best coverage
of any chain. Runs of words that no template holds are skipped, since the automaton would stay in its root there.

Templates are whole licence texts, or the notices that stand for long ones (``license_texts``).

Defined results: a null text is empty (0 words, no places, null first and last word, no labels, no spans, score 0); a null
doc_id is carried; repeated rows stay; a very long text is scanned whole, one at a time; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import table
from threadloom.llm.license_texts import TEMPLATES

#: phrase -> label
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
SEED = 4
GAP = 8
COVER = 0.6

#: A-Z to a-z, every other separator to a blank; UTF-8 bytes from 0x80 on belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; every state knows where in the templates it ends."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for at, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((k, at + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()
        self.below: dict[int, dict[int, tuple[int, int]]] = {}
        self.words = {w for seq in sequences for w in seq}

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.length.append(length)
        self.next.append(nexts)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another template has this passage
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _shorter(self, state: int, least: int) -> dict[int, tuple[int, int]]:
        """template -> (length, state) of the longest shorter passage, for templates that the passage of ``state`` does not hold."""
        found = self.below.get(state)
        if found is None:
            found, held, at = {}, {k for k, _ in self.ends[state]}, self.link[state]
            while at > 0 and self.length[at] >= least:
                for k in {k for k, _ in self.ends[at]} - held:
                    found[k] = (self.length[at], at)
                    held.add(k)
                at = self.link[at]
            self.below[state] = found
        return found

    def maximal_by_template(self, run: list[bytes], least: int) -> list[tuple[int, int, int, int]]:
        """(template, start, length, state) of passages in ``run`` that cannot be made longer within that template."""
        out, state, size, before = [], 0, 0, {}
        for i, w in enumerate(run):
            to = self.next[state].get(w)
            while state and to is None:
                state = self.link[state]
                size = self.length[state]
                to = self.next[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            now = {}
            if size >= least:
                now = dict(self._shorter(state, least))
                for k, _ in self.ends[state]:
                    now[k] = (size, state)
            for k, (n, s) in before.items():
                if k not in now or now[k][0] != n + 1:
                    out.append((k, i - n, n, s))
            before = now
        out += [(k, len(run) - n, n, s) for k, (n, s) in before.items()]
        return out

    def maximal(self, run: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of passages in ``run`` that cannot be made longer, of ``least`` words or more."""
        out, state, size = [], 0, 0
        for i, w in enumerate(run):
            to = self.next[state].get(w)
            if to is None:
                if size >= least:
                    out.append((i - size, size, state))
                while state and to is None:
                    state = self.link[state]
                    size = self.length[state]
                    to = self.next[state].get(w)
                if to is None:
                    continue
            state, size = to, size + 1
        if size >= least:
            out.append((len(run) - size, size, state))
        return out


_PASSAGE = ("start", "template_start", "words")


def added(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Words that passage ``b`` adds behind ``a`` in one chain; 0 where it cannot follow. Overlaps count once."""
    gap, tpl_gap = b[0] - a[0] - a[2], b[1] - a[1] - a[2]
    over = max(0, -gap, -tpl_gap)
    return b[2] - over if over < b[2] and a[0] <= b[0] and a[1] <= b[1] and max(gap, tpl_gap) + over <= GAP else 0


@dataclass
class Chain:
    """A chain of passages of one template, by its last one."""

    template: int
    end: int
    coverage: float
    last: int
    hits: list[tuple[int, int, int]]
    back: list[int]

    def passages(self) -> list[tuple[int, int, int]]:
        out, i = [], self.last
        while i >= 0:
            out.append(self.hits[i])
            i = self.back[i]
        return out[::-1]


class Scanner:
    """Templates and phrases, ready to scan."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        sequences = [words(text.encode()) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.runs = re.compile(b"\\x01{%d,}" % min(SEED, *self.sizes))

    def places(self, found: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            first, n = phrase[0], len(phrase)
            at = -1
            for _ in range(found.count(first)):
                at = found.index(first, at + 1)
                if tuple(found[at : at + n]) == phrase:
                    out.append((at, label))
        return out

    def passages(self, found: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """template -> sorted (text start, template start, words) of every maximal passage."""
        known = self.automaton.words
        flags = bytes([w in known for w in found])
        per: dict[int, list[tuple[int, int, int]]] = {}
        for run in self.runs.finditer(flags):
            for k, start, size, state in self.automaton.maximal_by_template(found[run.start() : run.end()], SEED):
                per.setdefault(k, []).extend((run.start() + start, end - size, size) for t, end in self.automaton.ends[state] if t == k)
        return {k: sorted(hits) for k, hits in per.items()}

    def chains(self, found: list[bytes]) -> list[Chain]:
        """The best chain that ends at each passage, per template."""
        out = []
        for k, hits in self.passages(found).items():
            best: list[int] = []  # covered words
            back: list[int] = []  # passage before
            low = 0
            for i, (at, tpl, size) in enumerate(hits):
                while hits[low][0] + self.sizes[k] + GAP < at:
                    low += 1
                covered, before = size, -1
                for j in range(i - 1, low - 1, -1):
                    more = added(hits[j], hits[i])
                    if more and best[j] + more > covered:
                        covered, before = best[j] + more, j
                best.append(covered)
                back.append(before)
            for i, (at, _, size) in enumerate(hits):
                out.append(Chain(k, at + size, best[i] / self.sizes[k], i, hits, back))
        return out

    def spans(self, chains: list[Chain]) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(template, coverage, passages) of chains that cover enough, of overlapping ones the best, in order of the text."""
        out, taken = [], {}
        for c in sorted((c for c in chains if c.coverage >= COVER), key=lambda c: (-c.coverage, c.template, c.end)):
            parts = c.passages()
            held = taken.setdefault(c.template, [])
            at = bisect.bisect_left(held, (parts[0][0], 0))
            if (at and held[at - 1][1] > parts[0][0]) or (at < len(held) and held[at][0] < c.end):
                continue
            held.insert(at, (parts[0][0], c.end))
            out.append((c.template, c.coverage, parts))
        return sorted(out, key=lambda x: (x[2][0][0], x[0]))

    def scan(self, text: bytes | None) -> tuple:
        """Words, places, first and last place, base labels, all labels, score, spans."""
        found = words(text or b"")
        places = self.places(found)
        chains = self.chains(found)
        spans = self.spans(chains)
        base = sorted({label for _, label in places})
        more = sorted({*base, *(self.labels[k] for k, _, _ in spans)})
        starts = [at for at, _ in places]
        score = max((c.coverage for c in chains), default=0.0)
        shown = [
            {"label": self.labels[k], "coverage": c, "first_word": p[0][0], "end_word": p[-1][0] + p[-1][2], "passages": [dict(zip(_PASSAGE, x)) for x in p]}
            for k, c, p in spans
        ]
        return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(more), score, shown


@cache
def _scanner() -> Scanner:
    return Scanner()


_SPAN = pa.struct(
    [("label", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("passages", pa.list_(pa.struct([(c, pa.int64()) for c in _PASSAGE])))]
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = _scanner().scan
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN))
    for b in batches:
        rows = [scan(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        )


def license_labels(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base and all labels, best coverage, and the covered spans."""
    kind = dict(docs.dtypes)["doc_id"]
    passages = "array<struct<" + ", ".join(f"{c}: bigint" for c in _PASSAGE) + ">>"
    return docs.select("doc_id", "text").mapInArrow(
        _run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        f"spans array<struct<label: string, coverage: double, first_word: bigint, end_word: bigint, passages: {passages}>>",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document; labels and score are read off the spans and chains."""
    found = license_labels(table(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["end_word"])), ",")
    return found.withColumn("spans", shown)

"""Phrase collocations: contiguous patterns grown to the right from projected occurrences, one distributed task per prefix.

1. *Words.* Every text is cut once; words are counted per language, pre-aggregated in each task.
2. *Projection.* Every occurrence of a word is a pointer with the up to three words that follow it in its piece. Pointers
   go to the task of their prefix, equal ones of a block of texts as one with a count, all of a prefix in one row.
   A prefix of many occurrences is replaced by the longer prefixes that start with it, up to the whole phrase of four
   words, whose row is but a count; so no task gets a hot word. Which prefixes are hot is told from the first pass: a
   phrase of more than a ``HOT``-th of all words is more than that of some block of texts, so blocks report their own
   frequent phrases, at most ``HOT`` of each length. A prefix that counts as cold has fewer than 2 / ``HOT`` of all words,
   and ``SLACK`` a block. There are fewer than ``HOT`` hot prefixes of each length, which are broadcast; they say where an occurrence is counted, never whether.
3. *Growth.* In the task of a prefix its pointers are grouped by the next word; each group of ``least`` occurrences or more
   is a longer prefix with its own projected pointers, and is grown in turn, depth first. Tasks read their prefixes in
   order and hold ``CHUNK`` pointers at a time; equal pointers of a larger group are merged as they come.
4. *Scores.* The parts of a candidate are frequent themselves, so they are found by key in the table of frequent phrases,
   the keys that many candidates ask for spread (``join_spread``). All arithmetic is on whole numbers, products as decimals.

Defined results: a null text is empty; a null language is ``und``; repeated rows and null ids count like others, as ids are
not looked at; a very long text is read in slices that end where a piece ends; ties are settled by phrase; an empty table
gives an empty result; extra columns of the input are ignored. Texts are UTF-8, so no word holds the byte FF.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import join_spread, materialise, table

LEAST = 30
LONGEST = 4
#: A candidate goes if a longer one that holds it has this share (per cent) of its occurrences.
INSIDE = 80
TOP = 2000
#: A hot prefix has more than a HOT-th of all words, and more than GROUP occurrences.
HOT = 1 << 17
GROUP = 1 << 16
#: Blocks report phrases of more than so many occurrences.
SLACK = 8
#: Words and end marks of one language in a block, blocks' worth of words that wait in all, and bytes of a text that are cut at a time.
BLOCK = 1 << 19
HELD = 4
SLICE = 1 << 18
#: Windows of a block whose pointers are written at a time.
PART = 1 << 16
#: Pointers that a task grows at a time.
CHUNK = 1 << 18

_END = b"\xff"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in slices, with the end mark after every piece."""
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        end = data.find(_END, at + SLICE) + 1 or len(data)
        yield [*data[at:end].replace(_END, b" \xff ").split(), _END]
        at = end


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(language, words with end marks, joined by blanks): some ``size`` words of a language, or its share when all have ``HELD`` times as many."""
    held, n, total = defaultdict(list), defaultdict(int), 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for k, lang in enumerate(b.column("lang").to_pylist()):
            for words in slices(texts[k].as_py() or b""):
                held[lang].append(b" ".join(words))
                n[lang] += len(words)
                total += len(words)
                full = lang if n[lang] >= size else max(n, key=n.get) if total >= HELD * size else None
                if full is not None:
                    total -= n.pop(full)
                    yield full, b" ".join(held.pop(full))
    for lang in list(held):
        yield lang, b" ".join(held.pop(lang))


class Block:
    """Words of one language in one block, as numbers, with the words that follow each in its piece (-1: none)."""

    def __init__(self, words: bytes, longest: int) -> None:
        coded = pc.split_pattern(pa.array([words], pa.binary()), " ").values.dictionary_encode()
        self.words = coded.dictionary
        mark = pc.index(self.words, pa.scalar(_END, pa.binary())).as_py()
        codes = np.append(coded.indices.to_numpy(zero_copy_only=False), np.full(longest, mark, np.int32))
        starts = codes[:-longest] != mark
        self.n = int(np.count_nonzero(starts))
        over = np.zeros(self.n, bool)
        self.next = []
        for k in range(longest):
            c = codes[k : k + len(starts)][starts]
            over |= c == mark
            self.next.append(np.where(over, -1, c))

    def keys(self, length: int) -> np.ndarray:
        """A number for the phrase of ``length`` words that starts at each word, in the order of their codes; short ones stand before."""
        base = len(self.words) + 1
        out, most = self.next[0] + np.int64(1), base
        for c in self.next[1:length]:
            if most * base >= 1 << 63:
                out = np.unique(out, return_inverse=True)[1]
                most = self.n
            out *= base
            out += c
            out += 1
            most *= base
        return out

    def phrases(self, rows: np.ndarray, first: np.ndarray | int, end: np.ndarray | int) -> pa.Array:
        """Words ``first`` to ``end`` (exclusive) of the windows ``rows``, joined by blanks."""
        parts, blank = [], np.ones(len(rows), bool)
        for k, c in enumerate(self.next):
            c = c[rows]
            none = (c < 0) | (k < first) | (k >= end)
            blank &= none
            parts.append(self.words.take(pa.array(c, mask=none)))
        parts[0] = pc.if_else(pa.array(blank), pa.scalar(b"", pa.binary()), parts[0])  # the join leaves out rows without any part
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()), null_handling="skip")


_COUNTS = ["lang", "phrase", "k", "n"]


def _count(longest: int, hot: int, slack: int, size: int):
    """Words of each block, its own frequent phrases of 2 words and more, and its size as a row of no words."""

    def rows(lang: str, phrases: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
        m = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), phrases.view(pa.string()), pa.array(np.full(m, k, np.int32)), pa.array(n.astype(np.int64))], _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in blocks(batches, size):
            b = Block(words, longest)
            if not b.n:
                continue
            n = np.bincount(b.next[0], minlength=len(b.words))
            yield rows(lang, pa.array([b""], pa.binary()), 0, np.array([b.n]))
            held = np.flatnonzero(n)
            yield rows(lang, b.words.take(pa.array(held)), 1, n[held])
            least, live = max(slack, b.n / hot), np.arange(b.n)
            rank, counts = b.next[0].astype(np.int64), n
            for k in range(2, longest):  # a frequent phrase starts with a frequent one
                live = live[(counts[rank[live]] > least) & (b.next[k - 1][live] >= 0)]
                key, part, number = np.unique(rank[live] * len(b.words) + b.next[k - 1][live], return_inverse=True, return_counts=True)
                rank = np.zeros(b.n, np.int64)
                rank[live], counts = part, number
                often = np.flatnonzero(number > least)
                where = np.zeros(len(key), np.int64)
                where[part] = live
                yield rows(lang, b.phrases(where[often], 0, k), k, number[often])

    return run


def _hot_flags(b: Block, windows: np.ndarray, hot: list[pa.Array]) -> np.ndarray:
    """How many words the prefix of each window has: one more than its longest hot beginning, or all there are."""
    depth = np.ones(len(windows), np.int64)
    live = np.arange(len(windows))
    for k, phrases in enumerate(hot, 1):
        live = live[b.next[k - 1][windows[live]] >= 0]
        if not len(live) or not len(phrases):
            break
        found = pc.is_in(b.phrases(windows[live], 0, k), value_set=phrases).to_numpy(zero_copy_only=False)
        live = live[found]
        depth[live] = k + 1
    return depth


def _project(longest: int, size: int, hot, part: int = PART):
    """Pointers of each block by prefix: the words that follow, one line each, and how often; ``part`` windows in a batch."""

    def pointers(lang: str, b: Block, windows: np.ndarray, n: np.ndarray, known: list[pa.Array]) -> pa.RecordBatch:
        depth = _hot_flags(b, windows, known)
        held = sum((c[windows] >= 0).astype(np.int64) for c in b.next)
        ended = held < depth  # the piece ends within a hot prefix
        depth = np.minimum(depth, held)
        new = np.zeros(len(windows), bool)
        new[0] = True
        new[1:] = depth[1:] != depth[:-1]
        for k in range(longest):
            c = np.where(k < depth, b.next[k][windows], -2)
            new[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(new)
        bounds = pa.array(np.append(heads, len(windows)).astype(np.int32))
        lines = pc.binary_join(pa.ListArray.from_arrays(bounds, b.phrases(windows, depth, longest)), pa.scalar(b"\n", pa.binary()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(heads), pa.string()), b.phrases(windows[heads], 0, depth[heads]).view(pa.string()), pa.array(ended[heads]),
                lines.view(pa.string()), pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int64))),
            ],
            ["lang", "prefix", "ended", "lines", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for lang, words in blocks(batches, size):
            b = Block(words, longest)
            if not b.n:
                continue
            _, windows, n = np.unique(b.keys(longest), return_index=True, return_counts=True)
            for at in range(0, len(windows), part):
                yield pointers(lang, b, windows[at : at + part], n[at : at + part], known.get(lang, []))

    return run


class Projected:
    """Pointers of some prefixes: the numbers of the words that follow (-1: none) and their counts."""

    def __init__(self, lines: pa.Array, longest: int) -> None:
        parts = pc.split_pattern(lines, " ")
        sizes = np.where(pc.binary_length(lines).to_numpy(zero_copy_only=False) == 0, 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        starts = parts.offsets.to_numpy(zero_copy_only=False)[:-1].astype(np.int64)
        coded = parts.values.dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.next = [np.where(sizes > k, codes[np.where(sizes > k, starts + k, 0)], -1) for k in range(longest - 1)] if len(codes) else []

    def grow(self, phrase: str, at: np.ndarray, n: np.ndarray, step: int, room: int, least: int) -> Iterator[tuple[str, int]]:
        """Every frequent phrase that starts with ``phrase``, whose pointers are ``at``, depth first."""
        if step == room or step >= len(self.next):
            return
        word = self.next[step][at]
        on = np.flatnonzero(word >= 0)
        if not len(on):
            return
        order = on[np.argsort(word[on], kind="stable")]
        word, at, n = word[order], at[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        total = np.add.reduceat(n, heads)
        ends = np.append(heads[1:], len(at))
        for k in np.flatnonzero(total >= least):
            longer = f"{phrase} {self.words[int(word[heads[k]])].as_py()}"
            yield longer, int(total[k])
            part = slice(heads[k], ends[k])
            yield from self.grow(longer, at[part], n[part], step + 1, room, least)


def _merged(t: pa.Table) -> pa.Table:
    """One row for the rows of one prefix, equal pointers summed."""
    lines = pc.list_flatten(pc.split_pattern(t["lines"], "\n")).combine_chunks().dictionary_encode()
    counts = pc.list_flatten(t["n"]).to_numpy()
    n = np.zeros(len(lines.dictionary), np.int64)
    np.add.at(n, lines.indices.to_numpy(zero_copy_only=False), counts)
    one = t.slice(0, 1)
    for name, value in (("lines", "\n".join(lines.dictionary.to_pylist())), ("n", n.tolist())):
        k = t.schema.get_field_index(name)
        one = one.set_column(k, t.schema.field(k), pa.array([value], t.schema.field(k).type))
    return one


def _grown(least: int, longest: int, chunk: int):
    names = ["lang", "phrase", "k", "n"]

    def grown(t: pa.Table, partial: dict) -> list[tuple[str, str, int]]:
        """Frequent phrases of whole groups of prefixes; counts of hot prefixes go to ``partial``, as other tasks have the rest."""
        t = t.combine_chunks()
        langs, prefixes, ended = t["lang"].to_pylist(), t["prefix"].to_pylist(), t["ended"].to_pylist()
        sizes = pc.list_value_length(t["n"]).to_numpy()
        counts = pc.list_flatten(t["n"]).to_numpy()
        rows = [0] + [i for i in range(1, len(prefixes)) if prefixes[i] != prefixes[i - 1] or langs[i] != langs[i - 1]]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        bounds = offsets[[*rows, len(prefixes)]]
        total = np.add.reduceat(counts, bounds[:-1])
        projected = Projected(pc.list_flatten(pc.split_pattern(t["lines"], "\n")).combine_chunks(), longest)
        out = []
        for g, i in enumerate(rows):
            words = prefixes[i].split(" ")
            if len(words) > 2 or (ended[i] and len(words) == 2):
                for k in range(2, len(words) + ended[i]):
                    partial[langs[i], " ".join(words[:k])] += int(total[g])
            if total[g] < least or ended[i]:
                continue
            if len(words) > 1:
                out.append((langs[i], prefixes[i], int(total[g])))
            part = np.arange(bounds[g], bounds[g + 1])
            out.extend((langs[i], p, n) for p, n in projected.grow(prefixes[i], part, counts[part], 0, longest - len(words), least))
        return out

    def batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[1].count(" ") + 1 for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, partial = [], 0, defaultdict(int)
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            lines += len(b.column("n").flatten())
            if lines < chunk:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = (t["lang"][-1], t["prefix"][-1])
            open_ = pc.and_(pc.equal(t["lang"], last[0]), pc.equal(t["prefix"], last[1])).to_numpy()
            cut = int(len(open_) - np.count_nonzero(open_))
            if cut:
                yield batch(grown(t.slice(0, cut), partial))
            rest = t.slice(cut)
            if len(rest) > 1:
                rest = _merged(rest)
            held = rest.to_batches()
            lines = sum(len(x.column("n").flatten()) for x in held)
            lines = lines if lines < chunk // 2 else lines // 2  # a merged group that stays large is merged again once it has doubled
            if len(partial) >= chunk:
                yield batch([(*k, n) for k, n in partial.items()])
                partial.clear()
        if held:
            yield batch(grown(pa.Table.from_batches(held), partial))
        if partial:
            yield batch([(*k, n) for k, n in partial.items()])

    return run


def _key(lang: Column | str, phrase: Column | str) -> Column:
    """Language and phrase as one text; no phrase holds a line break."""
    return F.concat_ws("\n", phrase, lang)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, hot: int = HOT, group: int = GROUP, slack: int = SLACK, block: int = BLOCK, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, k, n): phrases of up to ``longest`` words with ``least`` occurrences or more; k = 0: all words of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    schema = "lang string, phrase string, k int, n bigint"
    first = texts.mapInArrow(_count(longest, hot, slack, block), schema).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    first = materialise(first.where((F.col("n") >= least) | (F.col("k") == 0)).select("lang", "phrase", "k", "n"))
    words = first.where("k = 0").agg(F.sum("n")).first()[0] or 0
    found = defaultdict(lambda: [[] for _ in range(longest - 1)])
    for r in first.where(F.col("k").between(1, longest - 1) & (F.col("n") > max(group, words // hot))).collect():  # fewer than ``hot`` of each length
        found[r.lang][r.k - 1].append(r.phrase.encode())
    known = spark.sparkContext.broadcast({lang: [pa.array(x, pa.binary()) for x in sets] for lang, sets in found.items()})
    rows = texts.mapInArrow(_project(longest, block, known, part), "lang string, prefix string, ended boolean, lines string, n array<bigint>")
    rows = rows.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    longer = rows.mapInArrow(_grown(least, longest, chunk), schema).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialise(first.where("k < 2").unionByName(longer))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, **tuning: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of every language."""
    found = frequent_phrases(docs, least, longest, **tuning)
    phrases = found.where("k > 0").withColumn("key", _key("lang", "phrase"))
    chosen = phrases.where("k > 1").withColumnRenamed("n", "a")
    first, rest = (lambda j: F.substring_index("phrase", " ", j)), (lambda j: F.expr(f"substring_index(phrase, ' ', {j} - k)"))
    cuts = F.flatten(F.array(*[
        F.when(F.col("k") > j, F.array(*[F.struct(F.lit(j).alias("cut"), F.lit(side).alias("side"), _key("lang", part(j)).alias("key")) for side, part in (("l", first), ("r", rest))]))
        .otherwise(F.array().cast("array<struct<cut: int, side: string, key: string>>")) for j in range(1, longest)
    ]))
    asked = materialise(chosen.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*"))
    often = asked.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    keyed = phrases.select("key", F.col("n").alias("f")).join(often.hint("shuffle_hash"), "key").withColumnRenamed("times", "n")
    parts = join_spread(asked, materialise(keyed), "key", asked.count())
    sides = [F.max(F.when((F.col("cut") == j) & (F.col("side") == s), F.col("f"))).alias(f"{s}{j}") for j in range(1, longest) for s in "lr"]
    exact = "decimal(20,0)"
    scores = [
        F.when(F.col(f"r{j}").isNotNull(), F.struct(
            F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as {exact})) div (cast(l{j} as {exact}) + cast(r{j} as {exact}))").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"),
        )) for j in range(1, longest)
    ]
    scored = parts.groupBy("lang", "phrase", "a").agg(*sides).select("lang", "phrase", "a", F.array_min(F.array(*scores)).alias("s"))
    # phrases within a longer one: its words from i on, m of them
    within = F.flatten(F.array(*[
        F.when(F.col("k") > m, F.expr(f"transform(sequence(0, k - {m}), i -> substring_index(substring_index(phrase, ' ', i + {m}), ' ', -{m}))")).otherwise(F.array().cast("array<string>"))
        for m in range(2, longest)
    ]))
    held = chosen.where("k > 2").select("lang", "a", F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | F.expr(f"cast(100 as {exact}) * cast(longer as {exact}) < cast({inside} as {exact}) * cast(a as {exact})")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = found.where("k = 0").select("lang", "n")
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("bigint"))


ORACLE = r"""
with pieces as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang,
          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
numbered as (select row_number() over () as id, * from pieces),
words as (select id, lang, unnest(w) as w1, generate_subscripts(w, 1) as i from numbered),
windows as (
  select lang, w1, w1 || ' ' || lead(w1, 1) over x as w2, w1 || ' ' || lead(w1, 1) over x || ' ' || lead(w1, 2) over x as w3,
    w1 || ' ' || lead(w1, 1) over x || ' ' || lead(w1, 2) over x || ' ' || lead(w1, 3) over x as w4
  from words window x as (partition by id order by i)),
f as (
  select lang, 1 as k, w1 as phrase, count(*) as n from windows group by all union all
  select lang, 2, w2, count(*) from windows where w2 is not null group by all union all
  select lang, 3, w3, count(*) from windows where w3 is not null group by all union all
  select lang, 4, w4, count(*) from windows where w4 is not null group by all),
total as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
often as (select * from f where n >= 30),
cand as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from often where k > 1),
cuts as (
  select c.lang, c.phrase, c.a, j, l.n as l, r.n as r, ((2000000::hugeint * c.a) // (l.n::hugeint + r.n))::bigint as score
  from cand c, (select unnest([1, 2, 3]) as j)
  join often l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:j], ' ')
  join often r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1:], ' ')
  where j < c.k),
low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_ as (
  select c.lang, array_to_string(c.w[i:i + m - 1], ' ') as phrase, max(c.a) as longer
  from cand c, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < c.k and i + m - 1 <= c.k group by 1, 2)
select low.lang, row_number() over (partition by low.lang order by score desc, a desc, encode(low.phrase)) as rank, low.phrase, a, l, r, total.n, score
from low join total on total.lang = low.lang left join inner_ h on h.lang = low.lang and h.phrase = low.phrase
where h.longer is null or 100::hugeint * h.longer < 80::hugeint * a
qualify rank <= 2000
"""

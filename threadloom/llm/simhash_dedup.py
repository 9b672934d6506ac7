"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints: 64 majority bits over the XXH64 (seed 42) of all word shingles of the whole text. Further lanes of 64
   bits, where asked for, come from the same hashes, mixed anew.
2. Equal fingerprints collapse to one row before anything is compared.
3. A single Gray order leaves a query of a few differing bits nearly every node, so there are several orders. Each has a
   mask, whose pattern is the upper node of the index: codes with the same masked bits stand under the same node.
   ``exact_masks``: two codes of at most ``limit`` differing bits agree on at least two of ``limit + 2`` segments, so one
   mask per pair of segments finds every link; more codes take more and narrower segments. ``sampled_masks``: bits drawn at
   random from all lanes, for links of more differing bits than pigeonholes reach. The stage joins most sets by them; an
   exact join over shingles finds the other links (``meeting_pairs``).
4. Codes are dealt out by upper node and sorted by Gray rank; each task descends its nodes and prunes whole groups by
   accumulated differences (``hamming_index``). A node returns at most (members - 1) links, which span its components.
5. An upper node of very many codes is split by finer masks, which multiply its rows by a constant, whatever its size.
   Exact masks so lose no link; sampled ones meet a link of the node with the probability that their number gives.
6. Components by star contraction; ``component_id`` is the smallest doc_id in it.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other; a very
long text is hashed whole, in pieces of bounded memory; rows with a null doc_id keep their fingerprint and component, and
never name one unless a component has no other id (then null); ties for the name go to the smallest doc_id; repeated rows
stay; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, join_spread, let, materialise, release, table, tidy, words_of
from threadloom.llm.components import components
from threadloom.llm.hamming_index import bucket_links

LIMIT = 4
WIDTH = 4
SEED = 42
#: The stage: five-word shingles and four lanes. Two texts that are just similar differ in 38.8 of the 256 bits on average,
#: with a deviation of 5.7, so 999 of 1000 such pairs stay within the limit. What the index misses, the exact join finds.
STAGE_WIDTH = 5
STAGE_LANES = 4
STAGE_LIMIT = 57
SIMILAR = 0.8
#: Share of candidates of just that similarity that the sampled masks meet; the stage takes every other mask.
MET = 0.999
#: Bounds are widened by so much, so that rounding drops no pair.
_SLACK = 1e-6
#: One more shared shingle is asked of a set's first ones for each so many that it holds.
_LEAD = 10
#: Bits of a first shingle. A chance meeting keeps a set in the running and loses none; 40 leave one in 500 shingles at 30 GB.
_FIRST_BITS = 40
#: An upper node over so many codes is split by finer masks, at most so many times.
CROWD = 1024
DEPTH = 2
_CROWDS = 1 << 14
_SAMPLE = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 16
#: So many bits add up without leaving a byte.
_BYTE = 255
_ALL = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; others are its bits mixed anew (multiply and shift)."""
    if not lane:
        return h
    x = h + np.uint64(lane * _GOLDEN & _ALL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int = WIDTH, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit SimHashes of one whole text, in pieces of bounded memory."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(lanes, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, n, _PIECE):
        part = words[at : min(at + _PIECE, n) + width - 1]
        line = b" ".join(part)
        ends = list(accumulate([len(w) + 1 for w in part]))
        starts = [0, *ends]
        k = min(width, len(part)) - 1
        h = np.array([xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, ends[k:])], dtype=np.uint64)
        every = h[:, None] if lanes == 1 else np.stack([_mixed(h, lane) for lane in range(lanes)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(every).view(np.uint8), axis=1, bitorder="little")
        for part_at in range(0, len(bits), _BYTE):
            ones += np.add.reduce(bits[part_at : part_at + _BYTE], axis=0, dtype=np.uint8)
    bits = (2 * ones > n).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _fingerprints(width: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_py(), width, lanes) for t in b.column("text")], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            kept = [c for c in b.schema.names if c != "text"]
            cols = [*map(b.column, kept), *[pa.array(np.ascontiguousarray(codes[:, k])) for k in range(lanes)]]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *_lanes(lanes)])

    return run


def _lanes(lanes: int) -> list[str]:
    return ["code", *[f"code{k}" for k in range(1, lanes)]]


def fingerprints(docs: DataFrame, width: int = WIDTH, lanes: int = 1, more: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, key, ``more``, code, ...) per row; key is a hash of the text as it is, each code a lane as a signed 64-bit number."""
    keyed = docs.select("doc_id", "text", F.xxhash64(docs["text"]).alias("key"), *more)
    made = ", ".join([f"{c} {kind}" for c, kind in keyed.dtypes if c != "text"] + [f"{c} bigint" for c in _lanes(lanes)])
    return keyed.mapInArrow(_fingerprints(width, lanes), made)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of nearly equal length over ``bits``."""
    edges = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]


def exact_masks(limit: int, codes: int, base: int = 0, spare: int = 2) -> list[int]:
    """Masks one of which any two codes of at most ``limit`` differing bits agree on; ``base`` is held already.

    ``spare`` segments more than the limit are kept equal; for more ``codes`` there are more of them, so that random
    codes meet few others under a node.
    """
    free = [b for b in range(64) if not base >> b & 1]
    while not base and spare < 4 and codes > 16 << (64 * spare // (limit + spare)):
        spare += 1
    parts = _cut(free, min(limit + spare, max(limit + 1, len(free))))
    return [base | sum(x) for x in combinations(parts, len(parts) - limit)]


def sampled_masks(codes: int, lanes: int, similar: float = SIMILAR, met: float = MET, seed: int = SEED) -> list[tuple[int, ...]]:
    """Masks (one word a lane) of random bits, so many that a share ``met`` of pairs just ``similar`` agrees on one.

    A bit of such a pair is equal with probability 1 - angle / pi. More ``codes`` take wider masks, so that random codes
    meet few others under a node, and with them more masks: their number grows as codes^0.24 for a similarity of 0.8.
    """
    width = max(13, codes.bit_length() - 8)
    equal = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    return _drawn(math.ceil(math.log(1 - met) / math.log(1 - equal**width)), width, (0,) * lanes, seed)


def _drawn(many: int, width: int, base: tuple[int, ...], seed: int = SEED) -> list[tuple[int, ...]]:
    rng = random.Random(f"{seed} {base}")
    free = [(k, b) for k, held in enumerate(base) for b in range(64) if not held >> b & 1]
    out = []
    for _ in range(many):
        mask = list(base)
        for k, b in rng.sample(free, min(width, len(free))):
            mask[k] |= 1 << b
        out.append(tuple(mask))
    return out


def _gray_rank(code: str) -> Column:
    r = F.col(code)
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r


def _linker(limit: int, lanes: int, name: str = "code", counts: bool = False):
    """A forest of links of every upper node, each end by its column ``name``."""

    def found(bucket: np.ndarray, codes: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, visited, pruned = bucket_links(bucket, codes, limit)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (visited, pruned, len(a))], ["groups", "pruned", "links"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by upper node and Gray rank; a node may span batches."""
        held: list[tuple[np.ndarray, ...]] = []

        def out(*more: np.ndarray) -> Iterator[pa.RecordBatch]:
            return found(*[np.concatenate(x) for x in zip(*held, more)])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            codes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _lanes(lanes)], axis=1).view(np.uint64)
            rows = (bucket, codes, batch.column(name).to_numpy(zero_copy_only=False))
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last or (held and held[-1][0][-1] != bucket[0]):
                yield from out(*[x[:last] for x in rows])
                held = []
            held.append(tuple(x[last:] for x in rows))
        if held:
            yield from out(*[x[:0] for x in held[0]])

    return run


def _placed(codes: DataFrame, orders: list[tuple[int, ...]], finer, crowd: int) -> DataFrame:
    """(bucket, columns of ``codes``): every code under its upper nodes; ``orders`` are masks, one word a lane; ``finer`` splits a mask."""
    spark, lanes = codes.sparkSession, len(orders[0])
    names, held = codes.columns, [f"m{k}" for k in range(lanes)]  # the lanes come first

    def under(rows: DataFrame) -> DataFrame:
        patterns = [F.col(c).bitwiseAND(F.col(f"mask.{m}")) for c, m in zip(names, held)]
        return rows.select("mask", *names, F.xxhash64(*[f"mask.{m}" for m in held], *patterns).alias("bucket"))

    masks = F.array(*[F.struct(*[F.lit(_signed(x)).alias(m) for m, x in zip(held, mask)]) for mask in orders])
    rows = under(codes.select(*names, F.explode(masks).alias("mask")))
    total, level, out = codes.count() * len(orders), set(orders), None
    for _ in range(DEPTH):
        # crowded nodes are recognised from a sample of codes, as nothing but the split depends on it
        least = max(crowd, total // _CROWDS) / _SAMPLE
        some = rows.where(F.pmod(F.xxhash64(F.lit(3), *names), F.lit(_SAMPLE)) == 0)
        hot = materialise(some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("bucket"))
        if hot.isEmpty():
            break
        few = F.broadcast(hot)  # at most _SAMPLE * _CROWDS rows, as each has more than ``least`` of the rows
        quiet = rows.join(few, "bucket", "left_anti").select("bucket", *names)
        out = quiet if out is None else out.unionByName(quiet)
        split = {m: finer(m) for m in level}
        kind = "struct<" + ", ".join(f"{m}: bigint" for m in held) + ">"
        known = [(tuple(map(_signed, m)), [tuple(map(_signed, x)) for x in xs]) for m, xs in split.items()]
        sub = F.broadcast(spark.createDataFrame(known, f"mask {kind}, masks array<{kind}>"))
        level = {x for xs in split.values() for x in xs}
        rows = under(rows.join(few, "bucket", "left_semi").join(sub, "mask").select(*names, F.explode("masks").alias("mask"))).distinct()
    rest = rows.select("bucket", *names)
    out = rest if out is None else out.unionByName(rest)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("rank", _gray_rank("code")).repartition(n, "bucket").sortWithinPartitions("bucket", "rank").select("bucket", *names)


def _exact(codes: DataFrame, limit: int, crowd: int) -> DataFrame:
    def tuples(codes: int, base: int = 0) -> list[tuple[int]]:
        return [(m,) for m in exact_masks(limit, codes, base)]

    return _placed(codes, tuples(codes.count()), lambda m: tuples(0, m[0]), crowd)


def links(codes: DataFrame, limit: int = LIMIT, crowd: int = CROWD) -> DataFrame:
    """(u, v): links of at most ``limit`` differing bits that span all components of distinct ``codes`` (code bigint)."""
    return _exact(codes, limit, crowd).mapInArrow(_linker(limit, 1), "u bigint, v bigint").where("u <> v")


def index_counts(codes: DataFrame, limit: int = LIMIT, crowd: int = CROWD) -> DataFrame:
    """(groups, pruned, links): nodes that queries met, those left out by accumulated differences, links returned."""
    met = _exact(codes, limit, crowd).mapInArrow(_linker(limit, 1, counts=True), "groups bigint, pruned bigint, links bigint")
    return met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("groups", "pruned", "links")])


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``docs`` (doc_id, text)."""
    prints = materialise(fingerprints(docs).drop("key"))
    classes = materialise(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    named = materialise(_named(classes, "code", components(links(classes.select("code"), limit)), F.min("least").alias("component_id")))
    return join_spread(prints, named.select("code", "component_id", "n"), "code", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _named(classes: DataFrame, node: str, roots: DataFrame, name: Column) -> DataFrame:
    """The rows of ``classes``, each with what ``name`` aggregates over its component; a large component is spread."""
    rooted = materialise(
        classes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    )
    names = materialise(rooted.groupBy("root").agg(name, F.count(F.lit(1)).alias("n")))
    return join_spread(rooted, names, "root", rooted.count())


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def grams(text: Column, width: int) -> Column:
    """Distinct word shingles of a whole text as hashes; fewer words: the whole sequence; none: empty. Native."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, F.array_distinct(each)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(words_of(ascii_lower(text)), of)


def _need(n: Column, least: float) -> Column:
    """What a set of ``n`` shingles shares at least with any that is similar to it."""
    return F.ceil(F.lit(least) * n - F.lit(_SLACK))


def _lead(n: Column) -> Column:
    return F.lit(1) + F.floor(n / F.lit(_LEAD))


def _described(text: Column, width: int, least: float) -> Column:
    """A text's set of shingles: its hash (node), its size (n) and, in one order for all sets, its first shingles, shortened (p).

    Of the shingles of two similar sets that both hold, the first stand among the first n - need(n) + 1 of either.
    """

    def of(g: Column) -> Column:
        n = F.size(g)
        first = F.slice(g, F.lit(1), (n - _need(n, least) + _lead(n)).cast("int"))
        short = F.transform(first, lambda x: F.shiftrightunsigned(x, 64 - _FIRST_BITS))
        return F.struct(F.xxhash64(g).alias("node"), n.alias("n"), short.alias("p"))

    return let(F.sort_array(grams(text, width)), of)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, g): the shingles of the representatives of ``nodes``; ``classes`` holds node and the representative's doc_id and key."""
    asked = classes.join(nodes.hint("merge"), "node").select("node", F.col("least.doc_id").alias("id"), F.col("least.key").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.xxhash64("text"))
    texts = docs.select("doc_id", "text").join(asked.hint("merge"), same).select("node", grams(F.col("text"), width).alias("g"))
    return texts.groupBy("node").agg(F.first("g").alias("g"))  # repeated rows have the same set


def similar_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (u, v: nodes) whose representatives' shingle sets have a Jaccard similarity of ``least`` or more.

    Only texts of linked nodes are cut into shingles.
    """
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = materialise(_sets(docs, classes, ends, width))
    left, right = sets.select(F.col("node").alias("u"), F.col("g").alias("a")), sets.select(F.col("node").alias("v"), F.col("g").alias("b"))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    out = materialise(both.where(F.col("common") >= F.lit(least) * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v"))
    release(sets)
    return out


def _apart(posts: DataFrame) -> DataFrame:
    """``posts`` (node, label, n, x) of the shingles x that nodes of several labels hold, with f, the number of their nodes."""
    held = posts.groupBy("x").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("f"))
    return posts.join(held.where("low <> high").select("x", "f").hint("merge"), "x")


def meeting_pairs(docs: DataFrame, classes: DataFrame, firsts: DataFrame, labelled: DataFrame, width: int, least: float) -> DataFrame:
    """(u, v): pairs of nodes of different labels; no pair of a similarity of ``least`` or more is missing.

    ``firsts`` holds node, n and p (``_described``), ``labelled`` node and label. Three bounds leave few pairs, all without loss:

    1. Similar sets of n and m shingles share need(n) of them, so a share of those in p, which are known before the rest.
    2. A set of which fewer than need(n) shingles are held under other labels has no link that is not known.
    3. With a set's shingles from rare to frequent, the first one that two similar sets share stands so early in both
       that what follows suffices.
    """
    n = F.col("n")
    # most shingles are held once, so they go before labels are looked at
    seen = firsts.select("node", F.explode("p").alias("x"))
    twice = seen.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("x")
    shared = materialise(seen.join(twice.hint("merge"), "x"))
    led = _apart(shared.join(labelled.hint("merge"), "node")).groupBy("node", "label").agg(F.count(F.lit(1)).alias("m"))
    alive = materialise(led.join(firsts.select("node", "n").hint("merge"), "node").where(F.col("m") >= _lead(_need(n, least))).select("node", "label"))
    release(shared)
    whole = materialise(_sets(docs, classes, alive.select("node"), width).join(alive.hint("merge"), "node"))
    posts = whole.select("node", "label", F.size("g").alias("n"), F.explode("g").alias("x"))
    rare = _apart(posts).groupBy("node", "label").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    early = rare.withColumn("spare", F.size("o") - _need(n, least)).where("spare >= 0")
    at = F.posexplode(F.slice("o", F.lit(1), (F.col("spare") + 1).cast("int"))).alias("i", "e")
    ranked = materialise(early.select("node", "label", "n", (n - F.size("o")).alias("before"), at).select("node", "label", "n", (n - F.col("before") - F.col("i")).alias("rest"), "e.x"))
    release(whole)
    # a shingle's holders of its commonest label do not meet each other
    each = ranked.groupBy("x", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("x").agg(F.max(F.struct("k", "label")).alias("top"))
    placed = ranked.join(each.select("x", F.col("top.label").alias("top")).hint("merge"), "x")
    a, b = placed.where("label <> top").alias("a"), placed.alias("b")
    enough = F.least("a.rest", "b.rest") >= F.lit(least / (1 + least)) * (F.col("a.n") + F.col("b.n")) - F.lit(_SLACK)
    once = (F.col("b.label") == F.col("b.top")) | (F.col("a.node") < F.col("b.node"))
    met = a.join(b.hint("merge"), (F.col("a.x") == F.col("b.x")) & (F.col("a.label") != F.col("b.label")) & once & enough)
    out = materialise(met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct())
    release(ranked)
    return out


def similar_groups(
    docs: DataFrame, width: int = STAGE_WIDTH, lanes: int = STAGE_LANES, limit: int = STAGE_LIMIT, least: float = SIMILAR, crowd: int = CROWD
) -> DataFrame:
    """(root, least) per distinct set of shingles: its group of near duplicates, and the row that speaks for it (doc_id, key, n).

    Sets are linked if their similarity is ``least`` or more; a group is all that chains of links reach. The index over
    ``lanes`` x 64 bits hands on a forest of candidates (at most ``limit`` differing), and those that pass the exact test
    join most sets. It may miss links, so an exact join follows over what it left apart (``meeting_pairs``): every link
    between two of its sets is found there, and pairs within one of them need no test. So groups are those of all links,
    whatever the index met. Only texts of equal sets count as equal, not those of equal fingerprints.
    """
    names = _lanes(lanes)
    described = _described(docs["text"], width, least).alias("set")
    made = materialise(fingerprints(docs, width, lanes, (described,)).select("doc_id", "key", *names, "set.*"))
    rows = made.groupBy("node", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in names])
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "n")
    classes = materialise(rows.groupBy("node").agg(F.min(row).alias("least"), *[F.first(c).alias(c) for c in names]))
    firsts = materialise(made.groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p")))
    release(made)
    codes = materialise(classes.groupBy(*names).agg(F.min("node").alias("node")))
    placed = _placed(codes, sampled_masks(classes.count(), lanes, least)[::2], lambda m: _drawn(16, 6, m), crowd)

    found = placed.mapInArrow(_linker(limit, lanes, "node"), "u bigint, v bigint")
    candidates = materialise(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    near = similar_pairs(docs, classes, candidates, width, least)
    roots = components(near)
    labelled = materialise(classes.select("node").join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("label")))
    stars = labelled.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v"))  # links of the index, spanned
    apart = similar_pairs(docs, classes, meeting_pairs(docs, classes, firsts, labelled, width, least), width, least)
    release(firsts)
    roots = components(stars.unionByName(apart))
    return classes.select("node", "least").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")


def survivors(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, key, n): the row that stays for each group of near duplicates, and how often ``docs`` repeats it."""
    with tidy(docs.sparkSession):
        grouped = similar_groups(docs, **settings).groupBy("root").agg(F.min("least").alias("least"))
        return materialise(grouped.select("least.doc_id", "least.key", "least.n"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (of repeated rows, one).

    Near duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or more, and chains of such texts;
    none is missed (``similar_groups``). Rows are told apart by doc_id and text: an id is null only where
    a group has no other, and neither null nor repeated ids mix up groups. Of one id's texts in a group, the one with the
    smallest hash stays. Null texts are empty, and of all texts without words one stays; an empty table gives an empty
    one; all columns come through, whatever their names.
    """
    found = survivors(docs)
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["key"])
    # always by key: a plan that broadcasts small inputs says nothing about large ones
    kept = docs.join(found.hint("merge"), same).select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), found["doc_id"], found["key"], found["n"]
    )
    if not found.where("n > 1").isEmpty():
        kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["doc_id", "key"]))
    return kept.select("doc.*")

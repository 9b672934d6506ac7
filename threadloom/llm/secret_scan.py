"""Secret scans (native): base patterns plus sliding-window entropy over candidate strings.

Candidates are the runs ``[A-Za-z0-9+/_=-]{20,}``. Each belongs to a character class (hex, or base64 for the rest). A
window of ``WINDOW`` characters slides over it; one count per character is raised for the character that enters and
lowered for the one that leaves, and the sum of c*log2(c) follows by table look-up in whole numbers, so the entropy of
every window costs one step. Windows at or over the class's threshold are hulled into one span.

Base spans are cut out of a candidate, and the window slides over each part that is left, so a key beside an access id or
an assignment is still found. The allow-list suppresses a part that it matches as a whole (``ALLOWED``), or of which its
placeholder words leave less than one window (``PLACEHOLDERS``); a key that merely holds such a word counts.

Positions are code points from 0, end exclusive. They come from splitting the text at the matches and summing lengths, so
everything stays in built-in expressions; texts without a match are settled by one regular-expression search.

Defined results: a null text is empty (no spans); a null doc_id is carried; repeated rows stay; spans of one start go by
kind; a very long text is scanned whole, in one row; an empty table gives an empty result; extra columns of the input are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import let, running_max, running_sum, table

WINDOW = 20
_SCALE = 1 << 20


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int
    least: int  # characters that the group must have


#: In the order of the kinds; character lists stand for (?i), which folds differently in other engines.
BASE: tuple[Pattern, ...] = (
    Pattern(
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", "[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate counts only if this matches: letters and digits both. Anchored, so long runs cost one pass.
MIXED = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])"


@dataclass(frozen=True)
class CharClass:
    kind: str
    regex: str
    alphabet: str
    bits: float  # entropy of a window from which it counts


CLASSES: tuple[CharClass, ...] = (
    CharClass("entropy_hex", "^[0-9A-Fa-f]+$", "0123456789abcdef", 2.8),
    CharClass("entropy_base64", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6),
)
#: Parts that are no secrets: UUIDs, a key that public manuals print, slugs and paths of plain words, dates and versions.
ALLOWED: tuple[str, ...] = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
    "^[-A-Za-z_/=+]*[0-9]{0,8}$",
    "^[0-9=+/_-]*$",
)
#: Words of made-up values.
PLACEHOLDERS = "(?i)example|sample|placeholder|dummy|changeme|x{4,}|0{4,}|1234567"
KINDS: tuple[str, ...] = tuple(p.kind for p in BASE) + tuple(c.kind for c in CLASSES)
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _located(text: Column, regex: str, group: int, keep) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches that ``keep`` (text of the group) holds for."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    r = F.lit(regex)

    def placed(m: Column) -> Column:
        whole = F.get(m, F.lit(0))["whole"]
        parts = F.get(m, F.lit(0))["parts"]
        inner = F.get(m, F.lit(0))["inner"]
        steps = F.transform(whole, lambda x, i: (F.length(x) + F.length(F.get(parts, i))).cast("bigint"))
        return let(
            running_sum(steps),
            lambda ends: F.filter(
                F.transform(
                    inner,
                    lambda t, i: F.struct(
                        (F.get(ends, i) - F.length(F.get(whole, i))).alias("start"), F.get(ends, i).alias("end"), t.alias("text")
                    ),
                ),
                lambda s: keep(s["text"]),
            ),
        )

    found = F.array(
        F.struct(
            F.regexp_extract_all(text, r, F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, r, F.lit(group)).alias("inner"),
            F.split(text, regex, -1).alias("parts"),
        )
    )
    return F.when(text.rlike(regex), let(found, placed)).otherwise(empty)


def _weights() -> Column:
    """c*log2(c) for c = 0..WINDOW in whole numbers."""
    return F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("bigint") for c in range(WINDOW + 1)])


def _entropy_span(text: Column, alphabet: str, bits: float) -> Column:
    """struct<first, last> hull (offsets in ``text``) of the windows of at least ``bits``; null fields if there is none."""
    least = WINDOW * math.log2(WINDOW) * _SCALE - bits * WINDOW * _SCALE  # the sum may be at most this

    def slide(args: Column) -> Column:
        codes, weight = args["codes"], args["weight"]
        zero = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("count"),
            F.lit(0).cast("bigint").alias("sum"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )

        def step(s: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.coalesce(F.get(codes, i - WINDOW), F.lit(-1))
            up, down = F.get(s["count"], enters), F.get(s["count"], leaves)
            changed = (
                s["sum"] + F.get(weight, up + 1) - F.get(weight, up)
                + F.coalesce(F.get(weight, down - 1) - F.get(weight, down), F.lit(0))
            )
            counts = F.transform(
                s["count"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0)
            )
            same = enters == leaves
            moved = F.when(same, s["sum"]).otherwise(changed)
            hit = (i >= WINDOW - 1) & (moved <= F.lit(round(least)))
            return F.struct(
                F.when(same, s["count"]).otherwise(counts).alias("count"),
                moved.alias("sum"),
                F.when(hit, F.coalesce(s["first"], i - (WINDOW - 1))).otherwise(s["first"]).alias("first"),
                F.when(hit, i + 1).otherwise(s["last"]).alias("last"),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
        )

    chars = F.filter(F.split(F.lower(text) if alphabet.islower() else text, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("int"))
    return let(F.struct(codes.alias("codes"), _weights().alias("weight")), slide)


def _columns(source: Column) -> tuple:
    """Base spans, candidates, the test that a part passes, and the function that turns it into a span."""
    text = F.coalesce(source, F.lit(""))

    def as_spans(p: Pattern, k: int) -> Column:
        hits = _located(text, p.regex, p.group, lambda t: F.length(t) >= p.least)
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(k).alias("kind"), h["end"].alias("end")))

    base = F.array_sort(F.concat(*[as_spans(p, k) for k, p in enumerate(BASE)])).cast(_SPAN)

    def secretive(t: Column) -> Column:
        ok = (F.length(t) >= WINDOW) & t.rlike(MIXED)
        for a in ALLOWED:
            ok = ok & ~t.rlike(a)
        return ok & (~t.rlike(PLACEHOLDERS) | (F.length(F.regexp_replace(t, PLACEHOLDERS, "")) >= WINDOW))

    def span(c: Column, k: int) -> Column:
        kind = F.lit(len(BASE) + k).alias("kind")
        return let(
            _entropy_span(c["text"], CLASSES[k].alphabet, CLASSES[k].bits),
            lambda s: F.struct((c["start"] + s["first"]).alias("start"), kind, (c["start"] + s["last"]).alias("end")),
        )

    def judged(c: Column) -> Column:
        picked = span(c, len(CLASSES) - 1)
        for k in range(len(CLASSES) - 2, -1, -1):
            picked = F.when(c["text"].rlike(CLASSES[k].regex), span(c, k)).otherwise(picked)
        return picked

    candidates = _located(text, CANDIDATE, 0, lambda t: t.rlike(MIXED))
    return base.alias("base"), candidates.alias("candidates"), secretive, judged


def spans(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``base`` and ``found``: sorted arrays of struct<start, kind, end>."""
    base, candidates, secretive, judged = _columns(F.col("text"))
    first = docs.select(*keep, base, candidates)
    # few texts have candidates, and only those need to know where base spans reach
    parts = F.when(
        F.size("candidates") > 0,
        let(
            F.struct(F.col("base").alias("base"), running_max(F.transform("base", lambda b: b["end"])).alias("reach")),
            lambda known: F.flatten(F.transform("candidates", lambda c: _left_over(c, known["base"], known["reach"]))),
        ),
    ).otherwise(F.col("candidates"))
    more = F.filter(F.transform(F.filter(parts, lambda c: secretive(c["text"])), judged), lambda s: s["start"].isNotNull())
    return first.select(*keep, "base", F.array_sort(F.concat("base", more.cast(_SPAN))).alias("found"))


def _first(n: Column, holds) -> Column:
    """The smallest index from 0 of which the monotone ``holds`` is true, or ``n``; by binary search."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        open_, yes = at["low"] < at["high"], holds(middle)
        return F.struct(
            F.when(open_ & ~yes, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & yes, middle).otherwise(at["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda at: at["low"])


def _left_over(c: Column, base: Column, reach: Column) -> Column:
    """The parts of ``c`` that no span of ``base`` (sorted by start; ``reach``: prefix maxima of the ends) covers."""
    n = F.size(base)

    def cut(at: Column) -> Column:
        touching = F.slice(base, at["low"] + 1, at["high"] - at["low"])
        # where each span begins, and how far those before it reach
        begins = F.concat(F.transform(touching, lambda b: b["start"]), F.array(c["end"]))
        ends = F.concat(F.array(c["start"]), F.slice(reach, at["low"] + 1, at["high"] - at["low"]))
        gaps = F.filter(F.zip_with(ends, begins, lambda a, b: F.struct(a.alias("start"), F.least(b, c["end"]).alias("end"))), lambda g: g["end"] > g["start"])
        return F.transform(
            gaps,
            lambda g: F.struct(
                g["start"].alias("start"), g["end"].alias("end"),
                F.substring(c["text"], (g["start"] - c["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).alias("text"),
            ),
        )

    whole = F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))
    touched = F.struct(
        _first(n, lambda i: F.get(reach, i) > c["start"]).alias("low"), _first(n, lambda i: F.get(base, i)["start"] >= c["end"]).alias("high")
    )
    return F.when(n == 0, whole).otherwise(let(touched, lambda at: F.when(at["low"] >= at["high"], whole).otherwise(cut(at))))


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans and all spans as text, per row of ``docs``."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    found = spans(docs, "doc_id")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("found").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans become one. Same columns."""
    held = spans(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), "_row")
    reached = held.select("_row", "found", running_max(F.transform("found", lambda s: s["end"])).alias("reach"))
    # a union begins where no earlier span reaches, and ends where the next one begins
    begins = F.filter(
        F.transform("found", lambda s, i: F.when((i == 0) | (s["start"] > F.get("reach", i - 1)), s["start"])), lambda x: x.isNotNull()
    )
    ends = F.filter(
        F.transform("reach", lambda e, i: F.when(F.coalesce(F.get("found", i + 1)["start"] > e, F.lit(True)), e)), lambda x: x.isNotNull()
    )
    cut = reached.select("_row", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("cut"))
    text = F.col("_row.text")

    def piece(c: Column, i: Column) -> Column:
        begin = F.coalesce(F.get("cut", i - 1)["end"], F.lit(0))
        return F.substring(text, (begin + 1).cast("int"), (c["start"] - begin).cast("int"))

    tail = F.substring(text, (F.try_element_at("cut", F.lit(-1))["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.size("cut") > 0, F.concat(F.array_join(F.transform("cut", piece), mark), F.lit(mark), tail)).otherwise(text)
    return cut.select(*[clean.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return report(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows; no document goes, null texts stay null."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out

"""Mixing sources to target weights by iterative proportional fitting (native).

1. Token weights are summed per cell (source, language, topic). Targets name the categories; everything else falls into
   the category ``*``, so the number of cells is bounded by the targets, whatever the number of sources.
2. The cells are gathered into one row of at most that many entries, and one SQL ``aggregate`` over ``ROUNDS`` rounds
   rakes them: per round and dimension each category is scaled to its target share.
3. A cell's factor (raked share by observed share) divided by the leading factor is the probability with which each of
   its documents stays; a hash of (seed, doc_id) decides, so a rerun or a lost executor gives the same sample.

Rare cells cannot set the rate of the corpus, as documents are not repeated:

* A category's target is at most ``REACH`` times its observed share; what it gives up goes to the others of its dimension
  in proportion to their targets. A category without tokens so gives up all of it.
* No cell's factor exceeds ``BOUND`` while raking; the other cells of its categories fill in.
* The leading factor is the largest one that cells of ``SCARCE`` of all tokens or more reach. Cells beyond it keep all
  their documents (probability 1) and stay below their raked share.

Tokens are words of ``[^\\x20\\x09-\\x0D]+``. Targets whose shares do not go together with the observed cells are met as
well as ROUNDS rounds can: ``residual`` is how far the raked share of any category is from its target at most, 0 where all
are met, and ``marginals`` shows every category.

The topic is a column where the caller names one (a model's or an editor's); otherwise the first of ``TOPICS`` that a whole
text matches, which is a coarse stand-in. Targets must add up to 1 in each dimension.

Defined results: null source, language or topic falls into ``*``; null texts have no tokens and stay with their cell's
probability; a very long text is split whole, in one row; a null doc_id hashes like any value; repeated rows and rows of
one id share one fate, so there are no ties; an empty table gives an empty result; extra columns of the input are ignored,
and may be called like columns of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import BLANKS, let, materialise, table

ROUNDS = 50
SEED = 20
REACH = 4.0
BOUND = 16.0
SCARCE = 0.01
REST = "*"
#: First match names the topic. Every pattern looks at a bounded stretch, so long runs cost no more than others.
TOPICS: tuple[tuple[str, str], ...] = (
    ("license", "[lL][iI][cC][eE][nN][cCsS][eE]"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\d{3}[-. ]\d{3}[-. ]\d{4}|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d"),
    ("numbers", r"\d{4}"),
)


@dataclass(frozen=True)
class Targets:
    """Shares per dimension; ``*`` stands for every other value and must be there."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]

    def __post_init__(self) -> None:
        for name, shares in self.dims():
            if REST not in shares or any(v < 0 for v in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
                raise ValueError(f"shares of {name} must hold {REST!r}, be 0 or more and add up to 1")

    def dims(self) -> tuple[tuple[str, dict[str, float]], ...]:
        return (("source", self.source), ("lang", self.lang), ("topic", self.topic))


PRODUCTION = Targets(
    source={f"src{i}": 0.0475 for i in range(20)} | {REST: 0.05},
    lang={"en": 0.54, "fr": 0.17, "de": 0.17, "es": 0.10, REST: 0.02},
    topic={"license": 0.02, "contact": 0.03, "numbers": 0.02, REST: 0.93},
)


def _category(value: Column, shares: dict[str, float]) -> Column:
    named = [k for k in shares if k != REST]
    return F.when(value.isin(*named), value).otherwise(F.lit(REST)) if named else F.lit(REST)


def topic_of(text: Column) -> Column:
    """The first topic whose pattern a whole text matches, or ``*``."""
    topic = F.lit(REST)
    for name, regex in reversed(TOPICS):
        topic = F.when(text.rlike(regex), F.lit(name)).otherwise(topic)
    return topic


def classify(docs: DataFrame, targets: Targets = PRODUCTION, *more: str, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic (categories of the targets) and n_tokens per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(BLANKS))
    topic = topic_of(text) if topic is None else topic
    return docs.select(
        "doc_id",
        _category(F.col("source"), targets.source).alias("source"),
        _category(F.col("lang"), targets.lang).alias("lang"),
        _category(topic, targets.topic).alias("topic"),
        F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("bigint").alias("n_tokens"),
        *more,
    )


def rake(cells: DataFrame, targets: Targets = PRODUCTION, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, tokens, factor, probability, residual per cell of ``cells`` (source, lang, topic, tokens)."""
    gathered = cells.agg(
        F.sort_array(F.collect_list(F.struct("source", "lang", "topic", F.col("tokens").cast("double").alias("tokens")))).alias("cells")
    ).where(F.size("cells") > 0)
    bound = prod(len(s) for _, s in targets.dims())

    def sums_of(weights: Column, cats: Column, names: Column) -> Column:
        return F.transform(
            names,
            lambda n: F.aggregate(F.zip_with(weights, cats, lambda w, c: F.when(c == n, w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b),
        )

    def total_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def reachable(name: str, shares: dict[str, float]) -> Column:
        """Targets of one dimension, none over REACH times the observed share; they add up to 1 if any can be met."""
        names, goals = F.array(*[F.lit(k) for k in shares]), F.array(*[F.lit(float(v)) for v in shares.values()])

        def filled(most: Column) -> Column:
            def more(scale: Column, _: Column) -> Column:
                held = total_of(F.zip_with(goals, most, lambda g, m: F.when(g * scale >= m, m).otherwise(0.0)))
                free = total_of(F.zip_with(goals, most, lambda g, m: F.when(g * scale >= m, 0.0).otherwise(g)))
                return F.when(free > 0, F.greatest(scale, (1 - held) / free)).otherwise(scale)

            # each step holds at least one more category at its limit, or nothing changes any more
            scale = F.aggregate(F.sequence(F.lit(0), F.lit(len(shares))), F.lit(0.0), more)
            return let(scale, lambda s: F.zip_with(goals, most, lambda g, m: F.least(g * s, m)))

        return let(
            F.transform(sums_of(F.col("start"), F.transform("cells", lambda c: c[name]), names), lambda x: x * F.lit(REACH)), filled
        )

    def scaled(weights: Column, cats: Column, names: Column, goals: Column) -> Column:
        def ratios(s: Column) -> Column:
            met = total_of(F.zip_with(s, goals, lambda x, g: F.when(x > 0, g).otherwise(0.0)))
            return let(met, lambda m: F.zip_with(s, goals, lambda x, g: F.when((x > 0) & (m > 0), g / m / x).otherwise(1.0)))

        moved = let(
            let(sums_of(weights, cats, names), ratios),
            lambda r: F.zip_with(weights, cats, lambda w, c: w * F.get(r, (F.array_position(names, c) - 1).cast("int"))),
        )
        return F.zip_with(moved, F.col("start"), lambda w, s: F.least(w, s * F.lit(BOUND)))

    def one_round(weights: Column, _: Column) -> Column:
        for name, shares in targets.dims():
            weights = fitted_to(weights, name, shares)
        return weights

    def fitted_to(weights: Column, name: str, shares: dict[str, float]) -> Column:
        names = F.array(*[F.lit(k) for k in shares])
        return let(weights, lambda w: scaled(w, F.transform("cells", lambda c: c[name]), names, F.col(f"goals_{name}")))

    def leading(pairs: Column) -> Column:
        """The largest factor that cells of SCARCE of the tokens or more reach; ``pairs``: factor and share per cell."""
        start = F.struct(F.lit(0.0).alias("held"), F.lit(None).cast("double").alias("most"))

        def step(acc: Column, p: Column) -> Column:
            held = acc["held"] + p["share"]
            return F.struct(
                held.alias("held"), F.when(acc["most"].isNull() & (held >= SCARCE), p["factor"]).otherwise(acc["most"]).alias("most")
            )

        return F.aggregate(F.sort_array(F.filter(pairs, lambda p: p["factor"].isNotNull()), asc=False), start, step, lambda acc: acc["most"])

    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["tokens"])
    start = let(total, lambda t: F.transform("cells", lambda c: F.when(t > 0, c["tokens"] / t).otherwise(0.0)))
    begun = gathered.select("cells", start.alias("start"))
    begun = begun.select("*", *[reachable(name, shares).alias(f"goals_{name}") for name, shares in targets.dims()])
    fitted = begun.select("cells", "start", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("start"), one_round).alias("fit"))
    def gaps(name: str, shares: dict[str, float]) -> Column:
        sums = sums_of(F.col("fit"), F.transform("cells", lambda c: c[name]), F.array(*[F.lit(k) for k in shares]))
        return F.zip_with(sums, F.array(*[F.lit(float(v)) for v in shares.values()]), lambda x, g: F.abs(x - g))

    worst = F.round(F.array_max(F.concat(*[gaps(name, shares) for name, shares in targets.dims()])), 6)
    factors = fitted.select(
        "cells", "start", worst.alias("residual"), F.zip_with("fit", "start", lambda f, s: F.when(s > 0, f / s).otherwise(F.lit(None))).alias("factors")
    ).select(
        "cells", "factors", "residual",
        leading(F.zip_with("factors", "start", lambda f, s: F.struct(f.alias("factor"), s.alias("share")))).alias("most"),
    )
    # a cell without tokens costs none, so its documents stay
    out = factors.select(F.posexplode("cells").alias("i", "cell"), "factors", "most", "residual").select(
        "cell.*", "residual",
        F.coalesce(F.get("factors", F.col("i")), F.lit(1.0)).alias("factor"),
        F.coalesce(F.least(F.get("factors", F.col("i")) / F.nullif(F.col("most"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0)).alias("probability"),
    )
    return out.limit(bound)


def mix(
    docs: DataFrame, targets: Targets = PRODUCTION, seed: int = SEED, keep: tuple[str, ...] = (), topic: Column | None = None
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, residual, sampled per row of ``docs``; ``row``: the ``keep`` columns."""
    plain = [F.col(c) for c in ("doc_id", "text", "source", "lang")] + ([topic.alias("_topic")] if topic is not None else [])
    named = F.col("_topic") if topic is not None else None
    rows = docs.select(*plain, *([F.struct(*[docs[c] for c in keep]).alias("_kept")] if keep else []))
    known = classify(rows, targets, *(("_kept",) if keep else ()), topic=named)
    if keep:  # texts are read again rather than written
        counted = classify(docs.select(*plain), targets, topic=named)
    else:
        counted = known = materialise(known)
    cells = counted.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    raked = F.broadcast(rake(cells, targets).drop("tokens"))  # bounded by the targets
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = known.join(raked, ["source", "lang", "topic"]).withColumn("sampled", draw < F.col("probability"))
    return drawn.withColumnRenamed("_kept", "row") if keep else drawn


def marginals(mixed: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """dimension, category, target, observed, expected: token shares before the draw and, on average, after it."""
    cells = mixed.groupBy("source", "lang", "topic", "probability").agg(F.sum("n_tokens").alias("n")).select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d, _ in targets.dims()])).alias("k"), "n", "probability"
    )
    sums = cells.groupBy("k.dimension", "k.category").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("probability")).alias("m"))
    whole = sums.groupBy("dimension").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))
    goals = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("category"), F.lit(float(v)).alias("target")) for d, s in targets.dims() for c, v in s.items()])
    )
    spark = mixed.sparkSession
    wanted = spark.range(1).select(goals.alias("g")).select("g.*")
    zero = F.lit(0.0)
    return (
        wanted.join(sums, ["dimension", "category"], "left").join(whole, "dimension", "left")
        .select(
            "dimension", "category", "target",
            F.coalesce(F.col("n") / F.nullif("all_n", F.lit(0)), zero).alias("observed"), F.coalesce(F.col("m") / F.nullif("all_m", F.lit(0.0)), zero).alias("expected"),
        )
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, probabilities and the draw for every document."""
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the draw keeps, with all their columns, each as often as ``docs`` has it; an empty table gives an empty one."""
    return mix(docs, keep=tuple(docs.columns)).where("sampled").select("row.*")

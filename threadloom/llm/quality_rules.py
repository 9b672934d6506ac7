"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document. The ledger keeps the measurements and one ``bigint`` whose bit ``r`` is set
when rule ``r`` failed. Policies are masks with a version: applying one is ``failures & mask = 0``, so a new policy never
reads the texts again. Ablations ("what would come back without this rule?") are sums over the distinct bit patterns, of
which there are at most 2^rules, so they pre-aggregate on the map side.

The stage's filter stands behind a column that depends on a row's place (``monotonically_increasing_id``): the optimiser
would otherwise push it below the ledger and evaluate its rules twice. The column changes nothing else and is not returned.

Defined results: a null or blank text has no words and fails the length rule; a null ``doc_id`` is carried through;
repeated rows give repeated rows; a very long text is measured whole, in one row; an empty table gives an empty ledger; other columns are dropped, so clashing names do
no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import BLANKS, let, table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: The order gives the bits; append only, so that stored ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
)
#: version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "shouting"),
}
BASE, PRODUCTION = "v1", "v2"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; exact, windows are compared as strings."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        hits = F.filter(
            s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])
        )
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # each window adds what the next one does not cover
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda a, b: a + b,
        )

    return let(F.sort_array(windows), lambda s: let(repeated(s), covered))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failures`` for every row of ``docs`` (doc_id, text); no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    first = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        lines.alias("lines"),
    )
    w = F.col("words")
    hashes = F.when(
        F.size(w) >= 4,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.select("*", hashes.alias("hashes"), F.array_join("words", "").alias("bare"))

    def without(pattern: str) -> Column:
        return (F.length("bare") - F.length(F.regexp_replace("bare", pattern, ""))).cast("bigint")

    # equal windows have equal hashes, so all-distinct hashes settle most documents without a sort
    measured = second.select(
        "doc_id",
        F.size(w).cast("bigint").alias("n_words"),
        F.length("bare").cast("bigint").alias("word_chars"),
        without(rf"[{SYMBOLS}]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("bigint"))
        .otherwise(_repeat_words(w))
        .alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        without(r"\p{Lu}+").alias("n_upper"),
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.select("*", total.alias("failures"))


def apply_policy(kept_ledger: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    """Adds a boolean: no rule of the policy failed."""
    return kept_ledger.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablations(kept_ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents it fails, those only it rejects, and what the policy keeps without it."""
    m = mask(policy)
    patterns = kept_ledger.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("bigint")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    held = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(RULES) if r.name in POLICIES[policy]])
    rules = kept_ledger.sparkSession.range(1).select(F.inline(held))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    exploded = patterns.select("f", "n", F.explode(F.array(*[F.lit(1 << i).cast("bigint") for i, r in enumerate(RULES) if r.name in POLICIES[policy]])).alias("bit"))
    sums = exploded.groupBy("bit").agg(
        total(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("f") == F.col("bit")).alias("only_this"),
        total((F.col("f") == 0) | (F.col("f") == F.col("bit"))).alias("kept_without"),
    )
    zero = F.lit(0).cast("bigint")
    return rules.join(sums, "bit", "left").select(
        "rule", *[F.coalesce(F.col(c), zero).alias(c) for c in ("failed", "only_this", "kept_without")]
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the base and the production policy."""
    out = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), BASE, "base_ok"), PRODUCTION)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_ok")).alias("base_failed"), "kept", "failures",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy rejects, alone and with others, and what would be kept without it."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps, with all their columns; an empty table gives an empty one."""
    keys = [c for c in docs.columns if c != "doc_id"]
    packed = docs.select(F.struct("doc_id", *keys).alias("doc_id"), F.col("text"))
    # a filter pushed below the ledger would evaluate its rules again; a column that depends on the place stops it
    judged = apply_policy(ledger(packed), PRODUCTION).withColumn("_at", F.monotonically_increasing_id())
    kept = judged.where("kept and _at >= 0")
    return kept.select("doc_id.*").select(*docs.columns)


#: DuckDB: equal to op7's first eight columns and its bits.
ORACLE = r"""
with base as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
       regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') as bare from base),
x as (select *, len(words) as n, list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as win from w),
y as (select *, case when n >= 3 and len(list_distinct(win)) < len(win) then list_histogram(win) end as hist from x),
m as (select doc_id, n::bigint as n_words, length(bare)::bigint as word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
       (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
       case when hist is null then 0 else len(list_filter(range(1, n + 1), lambda i: (i <= n - 2 and hist[win[i]] >= 2) or (i >= 2 and i <= n - 1 and hist[win[i - 1]] >= 2) or (i >= 3 and hist[win[i - 2]] >= 2))) end::bigint as n_repeat_words,
       len(lines)::bigint as n_lines, (length(bare) - length(regexp_replace(bare, '\p{Lu}', '', 'g')))::bigint as n_upper from y),
b as (select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
       + 8 * (100 * n_dup_lines > 60 * n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint
       + 32 * (100 * n_upper > 50 * word_chars)::bigint)::bigint as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed, failures = 0 as kept, failures from b
"""

#: DuckDB: ablations from the failure bits.
ABLATIONS = f"""
with f as (select failures as f, count(*) as n from ({ORACLE}) group by 1),
r as (select unnest([{", ".join(f"'{r.name}'" for r in RULES)}]) as rule, unnest([{", ".join(str(1 << i) for i in range(len(RULES)))}]) as bit)
select rule, coalesce(sum(n) filter (f & bit <> 0), 0)::bigint as failed, coalesce(sum(n) filter (f = bit), 0)::bigint as only_this,
  coalesce(sum(n) filter (f = 0 or f = bit), 0)::bigint as kept_without from r left join f on true group by rule
"""

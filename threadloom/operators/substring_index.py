"""Substring search through a stored index of character trigrams.

Every character of a text starts a gram of three characters; the last two grams reach over the end. The index keeps, for
each gram, sorted lists of the ids whose texts hold it. A gram that very many texts hold has several lists, dealt by a hash
of the id, so no list outgrows ``BLOCK`` ids on average, whatever the number of texts. Lists are stored in the order of
their grams, so a reader's filter on grams reaches the files and skips row groups.

A term of three characters or more asks for its rarest grams alone and keeps ids that all of them hold; a shorter term asks
for the grams that begin with it. What is left is verified against the texts, so the result is that of a scan.

Defined results: case is ignored; null and empty texts match nothing, nor do empty terms; rows with a null id are left out;
repeated rows of ``texts`` stay repeated; an empty table gives an empty index and result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Ids of one list, on average at most.
BLOCK = 1 << 14
#: Rarest grams of a term that are read.
RARE = 3
_END = "\x00"


def grams(text: Column) -> Column:
    """Distinct grams of a non-empty text, one from every character; linear in its length."""

    def of(chars: Column) -> Column:
        after = lambda i, k: F.coalesce(F.get(chars, i + k), F.lit(_END))
        return F.array_distinct(F.transform(chars, lambda x, i: F.concat(x, *[after(i, k) for k in range(1, GRAM)])))

    return F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))


def write_index(texts: DataFrame, path: str, block: int = BLOCK) -> None:
    """Stores the index of ``texts`` (id, text): rows (gram, part, n, ids) in the order of grams."""
    held = texts.select("id", F.lower("text").alias("text")).where("id is not null and text <> ''")
    parts = max(1, -(-held.count() // block))
    each = held.select("id", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(grams(F.col("text"))).alias("gram"))
    lists = each.groupBy("gram", "part").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rows = lists.select("gram", "part", F.size("ids").cast("bigint").alias("n"), "ids")
    rows.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _grams_of(low: str) -> list[str]:
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def candidates(index: DataFrame, lows: list[str]) -> DataFrame:
    """(low, id): ids that hold the rarest grams of each lower-case term; every text with the term is among them.

    Tables that are broadcast hold ``RARE`` rows a term; the driver gets one count per gram of the terms.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    whole, short = [t for t in lows if len(t) >= GRAM], [t for t in lows if 0 < len(t) < GRAM]
    asked = sorted({g for t in whole for g in _grams_of(t)})
    sizes = {}
    if asked:
        counts = index.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n"))
        sizes = {r["gram"]: r["n"] for r in counts.collect()}
    picked = {t: sorted(_grams_of(t), key=lambda g: (sizes[g], g))[:RARE] for t in whole if all(g in sizes for g in _grams_of(t))}
    out = spark.createDataFrame([], f"low string, id {kind}")
    if picked:
        rows = [(g, t, len(gs)) for t, gs in picked.items() for g in gs]
        wanted = F.broadcast(spark.createDataFrame(rows, "gram string, low string, need int"))
        lists = index.where(F.col("gram").isin(sorted({g for g, _, _ in rows}))).join(wanted, "gram")
        met = lists.select("low", "need", F.explode("ids").alias("id")).groupBy("low", "need", "id").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(met.where("n = need").select("low", "id"))
    if short:
        begun = F.lit(False)
        for t in short:
            begun = begun | F.col("gram").startswith(t)
        of = F.filter(F.array(*map(F.lit, short)), lambda t: F.startswith(F.col("gram"), t))
        lists = index.where(begun).select(F.explode(of).alias("low"), "ids")
        out = out.unionByName(lists.select("low", F.explode("ids").alias("id")).distinct())
    return out


def search(index: DataFrame, texts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id, place) for every row of ``texts`` (id, text) that holds a term; place counts characters from 1."""
    spark = index.sparkSession
    given = spark.createDataFrame([(t,) for t in sorted({t for t in terms if t})], "term string")
    known = [(r["term"], r["low"]) for r in given.select("term", F.lower("term").alias("low")).collect()]  # lower-cased as texts are
    found = candidates(index, sorted({low for _, low in known}))
    rows = texts.select("id", F.lower("text").alias("text")).join(found, "id").withColumn("place", F.expr("instr(text, low)"))
    names = F.broadcast(spark.createDataFrame(known, "term string, low string"))
    return rows.where("place > 0").select("id", "low", "place").join(names, "low").select("term", "id", "place")

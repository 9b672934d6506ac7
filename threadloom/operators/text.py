"""Text operators: de-duplication, language, TF-IDF keywords and search scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import sha256_hex, tokens

#: Words that carry no topic.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in "
    "into is it its just me more my no not of on or our out over she should so some than that the their them then there these they this "
    "those to too under up us was we were what when where which who why will with would you your"
).split()
#: The most frequent function words by language, sixteen each.
PROFILES = {
    lang: tuple(words.split())
    for lang, words in {
        "de": "der die das und ist nicht ein zu mit von den auf sich eine dem für",
        "en": "the and of to in is that for was with it as on are this be",
        "es": "el los las y en que una por con para del se de la es como",
        "fr": "le la les de des et un une est que du dans pour pas qui sur",
        "it": "il di che la e per un una non con del della sono gli le nel",
        "nl": "de het een en van is dat niet op te met voor zijn die ik aan",
        "pl": "w i na z się nie do to jest że o jak po co ale za",
        "pt": "o os as de que e um uma não com para do da em no por",
        "ru": "и в не на что с он как это по но из у за от так",
        "sv": "och att det som en är på för av med inte den till ett om har",
    }.items()
}
VOCABULARY = 5000


def dedup_exact(rows: DataFrame, text: str = "text", order: tuple[str, ...] = ("seq",), scope: tuple[str, ...] = ()) -> DataFrame:
    """First row of every distinct text (within ``scope`` columns); the hash is the key, so long texts are not shuffled twice."""
    first = rows.groupBy(*scope, sha256_hex(F.coalesce(F.col(text), F.lit(""))).alias("_hash")).agg(F.min(F.struct(*order)).alias("_first"))
    hashed = rows.withColumn("_hash", sha256_hex(F.coalesce(F.col(text), F.lit("")))).withColumn("_first", F.struct(*order))
    return hashed.join(first, [*scope, "_hash", "_first"], "left_semi").drop("_hash", "_first")


def detect_language(text: Column, least: int = 2, chars: int | None = 5000) -> Column:
    """The profile with most function words among the first ``chars`` characters (None: all); under ``least`` hits: 'unknown'."""
    some = F.lower(F.substring(text, 1, chars) if chars else text)
    every = sorted({w for words in PROFILES.values() for w in words})
    # cut once, to the few words that any profile has
    hits = F.array(F.filter(F.split(some, r"[^\p{L}]+", -1), lambda w: w.isin(*every)))

    def best(found: Column) -> Column:
        def score(lang: str) -> Column:
            return F.struct(F.size(F.filter(found, lambda w: w.isin(*PROFILES[lang]))).alias("n"), F.lit(lang).alias("lang"))

        return F.greatest(*[score(k) for k in PROFILES])

    top = F.get(F.transform(hits, best), F.lit(0))
    return F.get(F.transform(F.array(top), lambda b: F.when(b["n"] >= least, b["lang"]).otherwise(F.lit("unknown"))), F.lit(0))


def term_counts(docs: DataFrame, stop: bool = True) -> DataFrame:
    """doc, term, tf of (doc, text)."""
    rows = docs.select("doc", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
    rows = rows.where(~F.col("term").isin(*STOP_WORDS)) if stop else rows
    return rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(
    docs: DataFrame, vocabulary: int = VOCABULARY, sublinear: bool = True, min_df: int = 1, max_df: float = 1.0, stop: bool = True
) -> DataFrame:
    """doc, term, weight: L2-normalised (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over the most frequent terms."""
    tf = term_counts(docs, stop)
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(total))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("cf"), "term").limit(vocabulary)
    idf = kept.select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    w = tf.join(F.broadcast(idf), "term").select("doc", "term", (raw * F.col("idf")).alias("w"))  # at most ``vocabulary`` rows
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", F.round(F.col("w") / length, 6).alias("weight"))


def tfidf_keywords(docs: DataFrame, per_doc: int = 5, **options) -> DataFrame:
    """The ``per_doc`` heaviest terms of each document."""
    order = Window.partitionBy("doc").orderBy(F.desc("weight"), "term")
    return tfidf(docs, **options).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_doc).drop("k")


def query_terms(query: str) -> list[str]:
    """Distinct lower-cased words of two characters or more."""
    import re

    return sorted({t for t in re.findall(r"\w+", query.lower()) if len(t) > 1})


def name_score(name: Column, terms: list[str], edges: bool = True) -> Column:
    """1 per term inside the name, and half a point more where the name starts or ends with it."""
    total = F.lit(0.0)
    low = F.lower(name)
    for t in terms:
        bonus = F.when(low.startswith(t) | low.endswith(t), 0.5).otherwise(0.0) if edges else F.lit(0.0)
        total = total + F.when(low.contains(t), F.lit(1.0) + bonus).otherwise(0.0)
    return total


def tfidf_search(docs: DataFrame, query: str, top: int = 20, least: float = 0.05) -> DataFrame:
    """Cosine of TF-IDF vectors between a query and documents (doc, text); raw tf, terms in 2 documents to 85 % of them."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc").cast("string").alias("doc"), "text")
    tf = term_counts(marked)
    n = marked.agg(F.count(F.lit(1)).alias("n"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(n))
    kept = stats.where((F.col("df") >= 2) & (F.col("df") <= 0.85 * F.col("n"))).orderBy(F.desc("cf"), "term").limit(VOCABULARY)
    idf = F.broadcast(kept.select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    asked = spark.createDataFrame([(query,)], "text string").select(F.explode(tokens(F.col("text"))).alias("term"))
    q = asked.groupBy("term").agg(F.count(F.lit(1)).alias("qtf")).join(idf, "term").select("term", (F.col("qtf") * F.col("idf")).alias("q"))
    weights = tf.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    qlen = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qlen"))
    hits = weights.join(F.broadcast(q), "term").groupBy("doc").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    scored = hits.join(lengths, "doc").join(F.broadcast(qlen)).select("doc", F.round(F.col("dot") / (F.col("length") * F.col("qlen")), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "doc").limit(top)

"""Quality classifier: hierarchical empirical Bayes over document, path and host.

1. One pass over the whole texts gives each document a short vector of shape measurements.
2. A logistic model is fitted on at most ``SAMPLE`` labelled documents (whole levels of the smallest hashes of doc_id; the
   only bounded sample here). The cut-off comes from counts per level, so no more than the sample ever travels to the
   driver, whatever the number of tasks or labels. A document's evidence is its log-odds under the model less the
   log-odds of the fitted base rate.
3. Good documents per path and host are grouped sums over all documents: a labelled document counts with its label, any
   other with its probability. The spread between sites, by moments, gives the strength of the prior: hosts shrink towards
   the global rate, paths towards their host; sparse sites shrink most. A document's own contribution is taken out of its
   sites before they speak about it, so its own label never reaches its score.
4. score = sigmoid(evidence + log-odds of the path posterior); kept from ``KEEP`` on.

Host is ``source``; the path below it is ``lang`` (for tables with URLs pass other columns). Sites of very many documents
are broadcast (a bounded number), all others joined by key, so no site's documents meet in one task.

Defined results: null texts are empty texts; very long texts are measured whole, one at a time; null hosts and paths are
sites of their own, named ''; a null doc_id is carried and has no label; repeated rows are scored one by one, each with
the label of its id; for the fit, an id's rows are averaged to one; a document with several labels has their mean; ties
of hashes fall into one level and are taken or left together; without any label the evidence is 0 and the rate 1/2, so all
documents stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import join_spread, materialise, table

SAMPLE = 20_000
KEEP = 0.5
RIDGE = 1.0
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 200.0)
FEATURES = ("words", "word_length", "symbols", "upper", "digits", "marks", "distinct_words", "distinct_windows", "distinct_lines")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def features(text: bytes | None) -> list[float]:
    """Shape of a whole text (UTF-8), each value within about 0 and 10."""
    b = text or b""
    words = b.split()
    n, size = len(words), max(1, len(b))

    def share(chars: bytes) -> float:
        return (len(b) - len(b.translate(None, chars))) / size

    lines = [x for x in b.split(b"\n") if x.strip()]
    windows = max(1, n - 2)
    return [
        float(np.log1p(n)),
        len(b) / max(1, n) / 5,
        min(10.0, 100 * share(b"#*$%&|<>")),
        10 * share(_UPPER),
        10 * share(_DIGITS),
        10 * share(b"!?"),
        float(np.log1p(len(set(words))) / max(1.0, np.log1p(n))),
        len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 1.0,
        len(set(lines)) / max(1, len(lines)) if lines else 1.0,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("doc_id", "host", "path")], pa.array(found, pa.list_(pa.float64()))], ["doc_id", "host", "path", "x"]
        )


def measured(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and measurements ``x`` per row of ``docs``; written once."""
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    below = F.concat_ws("/", site, F.coalesce(F.col(path).cast("string"), F.lit("")))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", site.alias("host"), below.alias("path"), "text")
    return materialise(rows.mapInArrow(_measure, f"doc_id {kind}, host string, path string, x array<double>"))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a ridge logistic model by Newton steps; y may be fractional."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, pull = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean)


def _logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior strength from the spread of site rates around ``mean`` beyond what sampling explains."""
    r = sites.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread")
    ).first()
    noise = mean * (1 - mean)
    if not r["sites"] or r["sites"] < 2:
        return STRENGTH[1]
    between = max(0.0, (r["spread"] - noise * r["sites"]) / r["n"])
    return float(min(STRENGTH[1], max(STRENGTH[0], noise / between - 1 if between > 0 else STRENGTH[1])))


def _strength_within(sites: DataFrame) -> float:
    """Prior strength of paths from their spread around the rate of their own host, beyond what sampling explains.

    A path is part of its host's rate, so it is off by the share 1 - path_n / host_n of what it would be off otherwise.
    """
    rate = F.col("host_good") / F.col("host_n")
    free = 1 - F.col("path_n") / F.col("host_n")
    r = sites.agg(
        F.sum(F.col("path_n") * F.pow(F.col("path_good") / F.col("path_n") - rate, 2)).alias("spread"), F.sum(rate * (1 - rate) * free).alias("noise"),
        F.sum(F.col("path_n") * free).alias("free"), (F.sum(F.col("path_n") * rate * (1 - rate)) / F.sum("path_n")).alias("each"),
    ).first()
    between = max(0.0, (r["spread"] - r["noise"]) / r["free"]) if r["free"] else 0.0
    return float(min(STRENGTH[1], max(STRENGTH[0], r["each"] / between - 1 if between > 0 else STRENGTH[1])))


def _cut_off(ids: DataFrame, sample: int) -> float:
    """The share of the hash range below which at most ``sample`` of the distinct ``ids`` lie.

    Levels are sixteenths of a power of two, so the driver sees at most 1024 counts.
    """
    level = F.floor(-16 * F.log2(_place(F.col("doc_id"))))
    counts = {r["level"]: r["n"] for r in ids.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, least = 0, None
    for k in sorted(counts, reverse=True):
        taken += counts[k]
        if taken > sample:
            return 0.0 if least is None else 2.0 ** (-least / 16)
        least = k
    return 1.0


def _place(key: Column) -> Column:
    """A hash of ``key`` as a number above 0 and up to 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(42), key), 11) + 1) / F.lit(float(1 << 53))


def labelled(known: DataFrame, said: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, x, y): at most ``sample`` documents of ``known`` (doc_id, x) with their mean label, those of least hash."""
    ids = known.select("doc_id").join(said.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    few = said.where(_place(F.col("doc_id")) <= F.lit(_cut_off(ids, sample)))
    means = [F.avg(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(len(FEATURES))]
    rows = known.join(few, "doc_id").groupBy("doc_id").agg(*means, F.first("y").alias("y"))
    return rows.select("doc_id", F.array(*[f"x{k}" for k in range(len(FEATURES))]).alias("x"), "y")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, kept per row of ``docs``."""
    known = measured(docs, host, path)
    said = materialise(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")))
    chosen = labelled(known, said, sample).select("x", "y").collect()  # at most ``sample`` rows
    if chosen:
        x, y = np.array([r["x"] for r in chosen]), np.array([r["y"] for r in chosen], dtype=float)
        weights, intercept = fit(x, y)
        rate = float(np.clip(y.mean(), 0.01, 0.99))
    else:
        weights, intercept, rate = np.zeros(len(FEATURES)), 0.0, 0.5
    base = float(np.log(rate / (1 - rate)))
    odds = F.lit(intercept)
    for k, w in enumerate(weights):
        odds = odds + F.get("x", F.lit(k)) * F.lit(float(w))
    odds = F.least(F.greatest(odds, F.lit(-12.0)), F.lit(12.0))
    plain = known.select("doc_id", "host", "path", odds.alias("odds"))
    # null ids have no label and would all meet in one task of the join
    told = plain.where("doc_id is not null").join(said, "doc_id", "left").unionByName(plain.where("doc_id is null").withColumn("y", F.lit(None).cast("double")))
    scored = materialise(told.withColumn("p", F.coalesce("y", 1 / (1 + F.exp(-F.col("odds"))))).drop("y"))
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).cast("double").alias("n")))
    hosts = materialise(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths")))
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("paths").alias("paths")).first()
    mean = float(np.clip(whole["good"] / whole["n"], 0.01, 0.99)) if whole["n"] else rate
    k_host = _strength(hosts, mean)
    above = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), F.col("paths").alias("n"))
    sites = join_spread(paths.select("path", "host", F.col("good").alias("path_good"), F.col("n").alias("path_n")), above, "host", int(whole["paths"] or 0))
    sites = materialise(sites.drop("host").withColumn("n", F.col("path_n")))
    k_path = _strength_within(sites)
    joined = join_spread(scored, sites, "path", int(whole["n"] or 0))
    host_post = (F.lit(k_host * mean) + F.col("host_good") - F.col("p")) / (F.lit(k_host) + F.col("host_n") - 1)
    path_post = (F.lit(k_path) * F.col("host_posterior") + F.col("path_good") - F.col("p")) / (F.lit(k_path) + F.col("path_n") - 1)
    inside = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-4)), F.lit(1 - 1e-4))
    return (
        joined.withColumn("host_posterior", host_post)
        .withColumn("path_posterior", path_post)
        .withColumn("evidence", F.col("odds") - F.lit(base))
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(inside)))))
        .select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("kept"))
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

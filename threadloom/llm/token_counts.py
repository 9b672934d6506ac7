"""Token counts per document without materialising ids.

1. Every text is cut into pre-tokens once; totals per distinct pre-token are pre-aggregated in each task and summed.
2. The number of ids is worked out once per distinct pre-token and kept as a table.
3. A document's count is the sum of frequency times ids over its own pre-tokens. The ``HEAD`` most frequent pre-tokens
   (a fixed bound of rows) are broadcast and settled where the document is read, which also takes the hot keys out of the
   shuffle; all others are joined by key. Both ways are exact; ``HEAD`` moves work only.

Defined results: a null text is empty (0 bytes, 0 tokens); a very long text is cut whole, one at a time; a null doc_id is carried; repeated rows (same doc_id) are
counted one by one; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe import default_path, encoder
from threadloom.llm.common import materialise, table

CONTEXT = 1024
#: Rows of the broadcast table; a worker holds them as a dict of some 30 MB.
HEAD = 1 << 18
#: Distinct pre-tokens that one task holds before it hands its sums on.
_HELD = 300_000


def _totals(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = encoder(path or default_path()).pieces, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    held.update(cut(t)[0])
                    if len(held) >= _HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def _sizes(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path or default_path()).count
        for b in batches:
            sizes = pa.array([count(p) for p in b.column("piece").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), sizes], ["piece", "n", "size"])

    return run


def _documents(path: str | None, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = encoder(path or default_path()).pieces, head.value.get
        # rows are told apart by place, so that repeated and null ids do no harm
        row = (TaskContext.get().partitionId() << 36) - 1
        for b in batches:
            at, ids, sizes, pieces, counts, sums = [], [], [], [], [], []
            for doc_id, size, t in zip(b.column(0).to_pylist(), b.column("n_bytes").to_pylist(), b.column("text").to_pylist()):
                row += 1
                found, total = cut(t) if t else ((), 0)
                rest: dict[str, int] = {}
                for p in found:
                    k = known(p)
                    if k:
                        total += k
                    else:
                        rest[p] = rest.get(p, 0) + 1
                k = len(rest)
                at += [row] * (k + 1)
                ids += [doc_id, *[None] * k]
                sizes += [size, *[None] * k]
                pieces += [f"\0{row}", *rest]
                counts += [0, *rest.values()]
                sums += [total, *[0] * k]
            longs = [pa.array(x, pa.int64()) for x in (at, sizes, counts, sums)]
            yield pa.RecordBatch.from_arrays(
                [longs[0], pa.array(ids, b.column(0).type), longs[1], pa.array(pieces, pa.string()), *longs[2:]],
                ["row", "doc_id", "n_bytes", "piece", "n", "settled"],
            )

    return run


def vocabulary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(piece, n, size): each distinct pre-token with its total frequency and its number of ids; written once."""
    found = docs.select("text").mapInArrow(_totals(path), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return materialise(found.mapInArrow(_sizes(path), "piece string, n bigint, size bigint"))


def frequent(words: DataFrame, head: int) -> DataFrame:
    """At most ``head`` of the most frequent pre-tokens, cut where a level of frequency would go beyond that.

    Levels are eighths of a power of two, so the driver sees some hundred counts and no task sorts the vocabulary.
    """
    level = F.floor(F.log2("n") * 8)
    counts = {r["level"]: r["rows"] for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    least, taken = None, 0
    for k in sorted(counts, reverse=True):
        taken += counts[k]
        if taken > head:
            break
        least = k
    return words.where(level >= least) if least is not None else words.where("false")


def count_tokens(docs: DataFrame, path: str | None = None, context: int = CONTEXT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs`` (doc_id, text). ``path``: vocabulary file on the executors."""
    words = vocabulary(docs, path)
    top = frequent(words, head).select("piece", "size").toPandas()
    common = docs.sparkSession.sparkContext.broadcast(dict(zip(top["piece"], top["size"].tolist())))
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "text")
    split = sized.mapInArrow(
        _documents(path, common),
        f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, piece string, n bigint, settled bigint",
    )
    # a document's own row carries what is settled under a key that no pre-token has, so it passes the same join
    summed = (
        split.join(words.select("piece", "size"), "piece", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("settled") + F.col("n") * F.coalesce("size", F.lit(0))).alias("n_tokens"),
        )
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))

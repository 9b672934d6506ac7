"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``:
rejected documents go, one document of each near-duplicate group stays, secrets are cut out of the texts, sources are
sampled to their target weights, and what is left is packed into sequences.

Defined results: null and blank texts fail the length rule and go in the first stage; a null source or language falls into
the category ``*``; null and repeated doc_ids are kept apart by their texts; of repeated rows one stays; very long texts
go through whole; ties are settled by doc_id, then by a hash of the text; an empty table gives an empty result; further
columns of ``documents`` come through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import mixing, packing, quality_rules, secret_scan, simhash_dedup
from threadloom.llm.common import materialise

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: Fingerprint links and packing are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each is written to the shared folder, as several later steps read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The declared shape of the graph, and a check of nodes against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: label -> (description, attributes)
NODES = {
    "Conversation": ("One exported conversation", ()),
    "Message": ("One turn", ("role", "text", "create_time")),
    "Entity": ("A named thing that messages mention", ("name", "entity_type")),
    "Keyword": ("A term that stands out in messages", ("name",)),
}
#: edge -> (source, target, symmetric, weighted, cardinality, derived)
EDGES = {
    "CONTAINS": ("Conversation", "Message", False, False, "1:N", False),
    "REPLIES_TO": ("Message", "Message", False, False, "1:N", False),
    "MENTIONS": ("Message", "Entity", False, False, "N:M", False),
    "CO_OCCURS_WITH": ("Entity", "Entity", True, True, "N:M", False),
    "HAS_KEYWORD": ("Message", "Keyword", False, True, "N:M", False),
    "HAS_TOPIC": ("Conversation", "Entity", False, True, "N:M", True),
    "SIMILAR_TO": ("Message", "Message", True, True, "N:M", True),
    "BRIDGES": ("Entity", "Entity", False, True, "N:M", True),
}


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, list(a)) for k, (d, a) in NODES.items()], "label string, description string, attributes array<string>")


def edges(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in EDGES.items()]
    return spark.createDataFrame(rows, "edge string, source string, target string, symmetric boolean, weighted boolean, cardinality string, derived boolean")


def violations(found: DataFrame) -> DataFrame:
    """(id, attribute): filled attributes that a node's label does not declare, and unknown labels (attribute 'label')."""
    out = found.where(~F.col("label").isin(*NODES)).select("id", F.lit("label").alias("attribute"))
    for c in ("role", "text", "name", "entity_type", "create_time"):
        allowed = [k for k, (_, a) in NODES.items() if c in a]
        filled = F.col(c).isNotNull() if c == "create_time" else F.coalesce(F.col(c), F.lit("")) != ""
        out = out.unionByName(found.where(filled & F.col("label").isin(*NODES) & ~F.col("label").isin(*allowed)).select("id", F.lit(c).alias("attribute")))
    return out

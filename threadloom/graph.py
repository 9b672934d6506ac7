"""The conversation graph as DataFrames, and how messages become one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import WORD_BREAK
from threadloom.operators.text import tfidf_keywords

NODE = "id string, label string, role string, text string, name string, entity_type string, create_time double"
EDGES = {
    "contains": "conv_id string, msg_id string",
    "replies": "parent_id string, child_id string",
    "mentions": "msg_id string, entity_id string",
    "cooc": "entity_a string, entity_b string, weight bigint",
    "keywords": "msg_id string, keyword_id string, weight double",
}
MESSAGE = "id string, role string, text string, parent string, create_time double, conversation_id string, lang string"
#: Entity types that carry no topic.
STOP_TYPES = ("CARDINAL", "DATE", "TIME", "MONEY", "PERCENT", "QUANTITY", "ORDINAL")
TEXT_KEPT = 1000


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    contains: DataFrame
    replies: DataFrame
    mentions: DataFrame
    cooc: DataFrame
    keywords: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def of(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    @cached_property
    def names(self) -> DataFrame:
        """id, name, entity_type; name and type fall back to the parts of the id."""
        part = lambda k: F.split_part("id", F.lit("::"), F.lit(k))
        return self.nodes.select(
            "id",
            "label",
            F.coalesce(F.nullif("name", F.lit("")), F.nullif(part(3), F.lit("")), F.col("id")).alias("name"),
            F.coalesce(F.nullif("entity_type", F.lit("")), F.when(F.col("label") == "Entity", part(2)), F.lit("")).alias("entity_type"),
        )

    def write(self, path: str) -> None:
        """One Parquet table per node set and edge type; nodes are partitioned by label."""
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        for t in EDGES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        """Tables that are missing columns get them as nulls; order of columns does not matter."""
        def table(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}")

        return Graph(table("nodes", NODE), **{t: table(t, s) for t, s in EDGES.items()})

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], NODE), **{t: spark.createDataFrame([], s) for t, s in EDGES.items()})


Extractor = Callable[[Column], Column]


def capitalised_terms(text: Column) -> Column:
    """The default extractor: capitalised words of four letters or more as array<struct<text, type>>; type by length."""
    words = F.filter(F.split(text, WORD_BREAK, -1), lambda w: w.rlike(r"^\p{Lu}\p{Ll}{3,}$"))
    kind = lambda w: F.when(F.length(w) <= 6, "ORG").when(F.length(w) <= 9, "PERSON").otherwise("PLACE")
    return F.transform(words, lambda w: F.struct(w.alias("text"), kind(w).alias("type")))


def known_terms(entries: dict[str, str]) -> Extractor:
    """A gazetteer: surface form -> type, matched word by word."""
    table = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])

    def extract(text: Column) -> Column:
        words = F.filter(F.split(text, WORD_BREAK, -1), lambda w: F.map_contains_key(table, w))
        return F.transform(words, lambda w: F.struct(w.alias("text"), F.try_element_at(table, w).alias("type")))

    return extract


def model_terms(find: Callable[[list[str]], list[list[tuple[str, str]]]]) -> Extractor:
    """A model: ``find`` gets a batch of texts and gives the (text, type) pairs of each. It runs on the executors."""

    @F.pandas_udf("array<struct<text:string,type:string>>")
    def extract(texts: pd.Series) -> pd.Series:
        found = find(texts.tolist())
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} answers to {len(texts)} texts")
        return pd.Series([[{"text": t, "type": k} for t, k in pairs] for pairs in found])

    return extract


def mentions_of(messages: DataFrame, extract: Extractor = capitalised_terms) -> DataFrame:
    """msg_id, entity_id, name, entity_type: at most one row per message and entity."""
    found = messages.select(F.col("id").alias("msg_id"), F.explode(extract(F.coalesce("text", F.lit("")))).alias("e"))
    kept = found.where(~F.col("e.type").isin(*STOP_TYPES))
    ident = F.concat(F.lit("entity::"), F.col("e.type"), F.lit("::"), F.lower("e.text"))
    return kept.groupBy("msg_id", ident.alias("entity_id")).agg(F.min("e.text").alias("name"), F.min("e.type").alias("entity_type"))


def pairs_of(mentions: DataFrame) -> DataFrame:
    """Co-occurrence a < b weighted by the number of messages that mention both."""
    a = mentions.select("msg_id", F.col("entity_id").alias("entity_a"))
    b = mentions.select("msg_id", F.col("entity_id").alias("entity_b"))
    both = a.join(b, "msg_id").where("entity_a < entity_b")
    return both.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("weight"))


def build(
    messages: DataFrame, extract: Extractor = capitalised_terms, langs: tuple[str, ...] | None = None, per_message: int = 5, earlier: DataFrame | None = None
) -> Graph:
    """The graph of a message table (``MESSAGE``). Texts are cut to 1000 characters in nodes.

    Replies need a parent among the messages or in ``earlier`` (id).
    """
    m = messages.where(F.col("lang").isin(*langs)) if langs else messages
    found = mentions_of(m, extract)
    words = tfidf_keywords(m.select(F.col("id").alias("doc"), "text"), per_doc=per_message)
    keywords = words.select(F.col("doc").alias("msg_id"), F.concat(F.lit("keyword::"), "term").alias("keyword_id"), "weight", "term")
    none, no_time = F.lit(""), F.lit(None).cast("double").alias("create_time")

    def nodes(df: DataFrame, label: str, **cols: Column) -> DataFrame:
        given = {"role": none, "text": none, "name": none, "entity_type": none} | cols
        time = given.pop("create_time", no_time)
        return df.select("id", F.lit(label).alias("label"), *[v.alias(k) for k, v in given.items()], time.alias("create_time"))

    entities = found.groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"))
    terms = keywords.select(F.col("keyword_id").alias("id"), F.col("term").alias("name")).distinct()
    convs = m.select(F.col("conversation_id").alias("id")).distinct()
    all_nodes = (
        nodes(convs, "Conversation")
        .unionByName(nodes(m, "Message", role=F.col("role"), text=F.substring("text", 1, TEXT_KEPT), create_time=F.col("create_time")))
        .unionByName(nodes(entities, "Entity", name=F.col("name"), entity_type=F.col("entity_type")))
        .unionByName(nodes(terms, "Keyword", name=F.col("name")))
    )
    mentions = found.select("msg_id", "entity_id")
    known = m.select(F.col("id").alias("parent_id"))
    if earlier is not None:
        known = known.unionAll(earlier.select("id"))
    replies = m.where("parent is not null").select(F.col("parent").alias("parent_id"), F.col("id").alias("child_id"))
    return Graph(
        nodes=all_nodes,
        contains=m.select(F.col("conversation_id").alias("conv_id"), F.col("id").alias("msg_id")),
        replies=replies.join(known, "parent_id", "left_semi"),
        mentions=mentions,
        cooc=pairs_of(mentions),
        keywords=keywords.select("msg_id", "keyword_id", "weight"),
    )


def merge(old: Graph, new: Graph) -> Graph:
    """Incremental union: nodes and edges once each, co-occurrence weights add up, a stored time survives a null one."""
    latest = old.nodes.withColumn("_new", F.lit(0)).unionByName(new.nodes.withColumn("_new", F.lit(1)))
    pick = lambda c: F.max_by(c, F.struct(F.col(c).isNotNull(), "_new")).alias(c)
    nodes = latest.groupBy("id").agg(*[pick(c) for c in ("label", "role", "text", "name", "entity_type", "create_time")])
    both = {t: getattr(old, t).unionByName(getattr(new, t)) for t in ("contains", "replies", "mentions")}
    cooc = old.cooc.unionByName(new.cooc).groupBy("entity_a", "entity_b").agg(F.sum("weight").alias("weight"))
    kw = old.keywords.withColumn("_new", F.lit(0)).unionByName(new.keywords.withColumn("_new", F.lit(1)))
    kw = kw.groupBy("msg_id", "keyword_id").agg(F.max_by("weight", "_new").alias("weight"))
    return replace(old, nodes=nodes, cooc=cooc, keywords=kw, **{t: df.distinct() for t, df in both.items()})

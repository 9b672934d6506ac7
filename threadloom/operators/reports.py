"""Reports over the graph: the tables that are handed out as CSV. Rounded to four digits, or six for betweenness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import cosine
from threadloom.graph import Graph
from threadloom.operators import algorithms as A
from threadloom.operators import relational as R
from threadloom.operators import temporal as T
from threadloom.operators import traversal as V


def _named(g: Graph, df: DataFrame, key: str = "entity_id") -> DataFrame:
    """``df`` with name and entity_type of its entities; unknown ones keep their rows."""
    return df.join(g.names.select(F.col("id").alias(key), "name", "entity_type"), key, "left")


def centrality(g: Graph, top: int = 20) -> DataFrame:
    return _named(g, A.entity_centrality(g, top).withColumnRenamed("id", "entity_id")).select("entity_id", "name", "entity_type", "betweenness", "degree")


def topics(g: Graph, least: int = 2) -> DataFrame:
    """Members of the communities with their degree inside."""
    comm = A.communities(g, least).select("id", "community")
    inside = A.inner_edges(A.cooc_edges(g, least), comm)
    deg = inside.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree_in_cluster"))
    rows = comm.join(deg, "id", "left").select(F.col("id").alias("entity_id"), F.col("community").alias("cluster"), F.coalesce("degree_in_cluster", F.lit(0)).alias("degree_in_cluster"))
    return _named(g, rows).select("entity_id", "name", "entity_type", "cluster", "degree_in_cluster")


def depth(g: Graph) -> DataFrame:
    """Shape of the reply chains of each conversation."""
    rows = V.depth_by_conversation(g).join(V.depth_distribution(g), "conv_id").join(R.conversation_titles(g), "conv_id", "left")
    return rows.select(
        "conv_id", F.coalesce("title", F.lit("")).alias("title"), F.col("messages").alias("messages_in_chain"), "max_depth", "mean_depth",
        F.col("branching").alias("branching_factor"), F.col("distribution").alias("depth_distribution"),
    )


def difference(a: Graph, b: Graph, top: int = 30) -> DataFrame:
    """Mentions of entities in two graphs."""
    names = a.names.unionByName(b.names).where("label = 'Entity'").groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"))
    rows = R.diff_mentions(a, b, top).join(names, "entity_id", "left")
    return rows.select("entity_id", "name", F.col("n_left").alias("left_mentions"), F.col("n_right").alias("right_mentions"), F.col("diff").alias("difference"), "lean")


def timeline(g: Graph, days: int = 30, top: int = 5) -> DataFrame:
    return T.timeline_wide(g, days, top)


def temporal(g: Graph, days: int = 30) -> DataFrame:
    rows = _named(g, T.metrics(g, days))
    return rows.select(
        "entity_id", "name", F.col("total").alias("total_mentions"), F.col("first").alias("first_bucket"), F.col("last").alias("last_bucket"), "active_buckets", "cv",
        F.col("bursts").alias("burst_buckets"),
    )


def similarity(g: Graph, least: float = 0.3, top: int | None = None) -> DataFrame:
    """Pairs of conversations with their titles."""
    t = R.conversation_titles(g)
    side = lambda c: t.select(F.col("conv_id").alias(f"conv_id_{c}"), F.col("title").alias(f"title_{c}"))
    rows = R.conversation_similarity(g, least, top).select(F.round("score", 4).alias("jaccard"), F.col("a").alias("conv_id_a"), F.col("b").alias("conv_id_b"))
    both = rows.join(side("a"), "conv_id_a", "left").join(side("b"), "conv_id_b", "left").fillna("", ["title_a", "title_b"])
    return both.select("jaccard", "conv_id_a", "conv_id_b", "title_a", "title_b")


def found(g: Graph, query: str, top: int = 50, cut: int = 300) -> DataFrame:
    """Messages that answer a query, with the names of all their entities and keywords."""
    hits = R.query_messages(g, query, top)

    def names(edges: DataFrame, key: str, alias: str) -> DataFrame:
        n = edges.join(hits, "msg_id", "left_semi").join(g.names.select(F.col("id").alias(key), "name"), key)
        return n.groupBy("msg_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias(alias))

    text = g.of("Message").select(F.col("id").alias("msg_id"), F.substring("text", 1, cut).alias("text"), F.col("create_time").alias("timestamp"))
    rows = hits.join(text, "msg_id").join(names(g.mentions, "entity_id", "entities"), "msg_id", "left").join(names(g.keywords, "keyword_id", "keywords"), "msg_id", "left")
    return rows.fillna("", ["entities", "keywords"]).select(
        "msg_id", "score", "role", "text", "entities", "keywords", F.col("conv_id").alias("conversation_id"), "timestamp"
    )


def neighbours(vectors: DataFrame, query: Column, key: str, vector: str, shown: list[str], top: int = 10) -> DataFrame:
    """The rows nearest to the one row for which ``query`` holds, by cosine, with columns ``shown``."""
    one = vectors.where(query).select(F.col(key).alias("_k"), F.col(vector).alias("_q")).orderBy("_k").limit(1)
    scored = vectors.join(F.broadcast(one), F.col(key) != F.col("_k"))
    rows = scored.select(F.col(key).alias("neighbor_id"), F.round(cosine(F.col("_q"), F.col(vector)), 4).alias("cosine_similarity"), *shown)
    return rows.orderBy(F.desc("cosine_similarity"), "neighbor_id").limit(top)

"""Statistics, search, ranking, set algebra and similarity over a graph. Ties in every ranking go to the smaller id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.graph import Graph
from threadloom.operators.text import name_score, query_terms
from threadloom.plans.ranking import global_rank
from threadloom.session import durable


def _count(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def _label(g: Graph, df: DataFrame, key: str) -> DataFrame:
    """Name and type beside an id; ids without a node keep the id's last part."""
    return df.join(g.names.select(F.col("id").alias(key), "name", "entity_type"), key, "left")


# counts


def nodes_by_label(g: Graph) -> DataFrame:
    return g.nodes.groupBy("label").agg(_count("n"))


def edge_counts(g: Graph) -> DataFrame:
    kinds = {"CONTAINS": g.contains, "REPLIES_TO": g.replies, "MENTIONS": g.mentions, "CO_OCCURS_WITH": g.cooc, "HAS_KEYWORD": g.keywords}
    parts = [df.agg(_count("n")).select(F.lit(k).alias("edge"), "n") for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_stats(g: Graph, types: int = 20) -> DataFrame:
    """kind, key, n: totals, nodes by label, edges, the most frequent entity types, roles."""
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "n")
    kinds = g.of("Entity").where("entity_type <> ''").groupBy("entity_type").agg(_count("n")).orderBy(F.desc("n"), "entity_type").limit(types)
    roles = g.of("Message").where("role <> ''").groupBy("role").agg(_count("n"))
    total = g.nodes.agg(_count("n")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("key"), "n")
    return (
        total.unionByName(row(nodes_by_label(g), "label", "label")).unionByName(row(edge_counts(g), "edge", "edge"))
        .unionByName(row(kinds, "entity_type", "entity_type")).unionByName(row(roles, "role", "role"))
    )


def mention_counts(g: Graph) -> DataFrame:
    return g.mentions.groupBy("entity_id").agg(_count("mentions"))


def keyword_stats(g: Graph) -> DataFrame:
    return g.keywords.groupBy("keyword_id").agg(
        _count("n"), F.round(F.sum("weight"), 7).alias("total"), F.round(F.avg("weight"), 7).alias("avg_weight")
    )


def conversation_entities(g: Graph) -> DataFrame:
    """conv_id, entity_id, n: mentions joined to conversations."""
    return g.mentions.join(g.contains, "msg_id").groupBy("conv_id", "entity_id").agg(_count("n"))


def top_conversation_entities(g: Graph, top: int = 5) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("n"), "entity_id")
    return conversation_entities(g).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def degree(g: Graph, least: int = 1) -> DataFrame:
    e = g.cooc.where(F.col("weight") >= least)
    ends = e.select(F.col("entity_a").alias("entity_id")).unionAll(e.select(F.col("entity_b").alias("entity_id")))
    return ends.groupBy("entity_id").agg(_count("degree"))


# search and ranking


def search_nodes(g: Graph, label: str | None = None, name: str = "", entity_type: str = "", limit: int = 50) -> DataFrame:
    out = g.of(label) if label else g.nodes
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    if entity_type:
        out = out.where(F.upper("entity_type") == entity_type.upper())
    return out.select("id", "label", "name", "entity_type").orderBy("id").limit(limit)


def search_entities(g: Graph, query: str, entity_type: str = "", limit: int = 20) -> DataFrame:
    hits = g.names.where((F.col("label") == "Entity") & F.lower("name").contains(query.lower()))
    if entity_type:
        hits = hits.where(F.upper("entity_type") == entity_type.upper())
    counted = hits.join(mention_counts(g), hits["id"] == F.col("entity_id"), "left")
    return (
        counted.select("id", "name", "entity_type", F.coalesce("mentions", F.lit(0)).cast("bigint").alias("mention_count"))
        .orderBy(F.desc("mention_count"), "id").limit(limit)
    )


def top_entities(g: Graph, entity_type: str = "", limit: int = 20) -> DataFrame:
    return search_entities(g, "", entity_type, limit)


def search_keywords(g: Graph, query: str, limit: int = 20) -> DataFrame:
    hits = g.names.where((F.col("label") == "Keyword") & F.lower("name").contains(query.lower())).select("id", "name")
    stats = keyword_stats(g).withColumnRenamed("keyword_id", "id")
    return hits.join(stats, "id").select("id", "name", "n", "avg_weight").orderBy(F.desc("n"), F.desc("avg_weight"), "id").limit(limit)


def top_keywords(g: Graph, limit: int = 20) -> DataFrame:
    return search_keywords(g, "", limit)


def keyword_messages(g: Graph, keyword_id: str, limit: int = 20, least: float = 0.0) -> DataFrame:
    hits = g.keywords.where((F.col("keyword_id") == keyword_id) & (F.col("weight") >= least)).orderBy(F.desc("weight"), "msg_id").limit(limit)
    return with_message(g, hits.select("msg_id", "weight"))


def entity_messages(g: Graph, entity_id: str, limit: int = 50) -> DataFrame:
    return with_message(g, g.mentions.where(F.col("entity_id") == entity_id).select("msg_id").orderBy("msg_id").limit(limit))


def with_message(g: Graph, rows: DataFrame, cut: int = 500) -> DataFrame:
    """Role, shortened text and conversation beside msg_id, empty where unknown."""
    m = g.of("Message").select(F.col("id").alias("msg_id"), "role", F.substring("text", 1, cut).alias("text"))
    c = g.contains.groupBy("msg_id").agg(F.max("conv_id").alias("conv_id"))
    joined = rows.join(m, "msg_id", "left").join(c, "msg_id", "left")
    return joined.select(*rows.columns, *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text", "conv_id")])


def cooccurring(g: Graph, entity_id: str, limit: int = 20) -> DataFrame:
    both = g.cooc.where(F.col("entity_a") == entity_id).select(F.col("entity_b").alias("entity_id"), "weight").unionByName(
        g.cooc.where(F.col("entity_b") == entity_id).select(F.col("entity_a").alias("entity_id"), "weight")
    )
    return _label(g, both.orderBy(F.desc("weight"), "entity_id").limit(limit), "entity_id")


def search_text(g: Graph, query: str, role: str = "", limit: int = 20, around: int = 80) -> DataFrame:
    """Messages that hold ``query`` in any case, with the place and a snippet around its first occurrence."""
    m = g.of("Message")
    m = m.where(F.col("role") == role) if role else m
    at = F.instr(F.lower("text"), query.lower())
    begin = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(query) + around, F.length("text") + 1)
    snippet = F.concat(
        F.when(begin > 1, "...").otherwise(""), F.substring(F.col("text"), begin, end - begin), F.when(end <= F.length("text"), "...").otherwise("")
    )
    return m.where(at > 0).select(F.col("id").alias("msg_id"), "role", at.alias("place"), snippet.alias("snippet")).orderBy("msg_id").limit(limit)


def conversation_titles(g: Graph, cut: int = 60) -> DataFrame:
    """The first non-blank message of every conversation by (create_time, id)."""
    m = g.of("Message").where("trim(text) <> ''").select(F.col("id").alias("msg_id"), "text", "create_time")
    first = g.contains.join(m, "msg_id").groupBy("conv_id").agg(F.min_by("text", F.struct("create_time", "msg_id")).alias("title"))
    return first.select("conv_id", F.substring("title", 1, cut).alias("title"))


# entities of conversations as sets


def entity_timeline(g: Graph, entity_id: str, other: str = "") -> DataFrame:
    """Conversations that mention an entity (and another one)."""
    ce = conversation_entities(g)
    own = ce.where(F.col("entity_id") == entity_id).select("conv_id")
    return own.intersect(ce.where(F.col("entity_id") == other).select("conv_id")) if other else own.distinct()


def _features(g: Graph) -> tuple[DataFrame, DataFrame]:
    ents = conversation_entities(g).select("conv_id", F.col("entity_id").alias("f"))
    keys = g.keywords.join(g.contains, "msg_id").select("conv_id", F.col("keyword_id").alias("f")).distinct()
    return ents, keys


def _jaccard_pairs(sets: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """a < b with a shared feature: inter and Jaccard of ``least`` or more; an inverted index, not all pairs.

    With a threshold only prefixes are indexed (``_similar_sets``). A feature that nearly every set holds is then met only
    where a set has little else.
    """
    if least > 0:
        return _similar_sets(sets, key, least - 1e-6)  # callers round
    size = sets.groupBy(key).agg(_count("n"))
    a, b = sets.select(F.col(key).alias("a"), "f"), sets.select(F.col(key).alias("b"), "f")
    inter = a.join(b, "f").where("a < b").groupBy("a", "b").agg(_count("inter"))
    na, nb = size.select(F.col(key).alias("a"), F.col("n").alias("na")), size.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    return inter.join(na, "a").join(nb, "b").select("a", "b", "inter", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


#: Rows of conversations' entities from which the best pairs are first looked for under higher bounds, as each takes joins of its own.
_MANY = 1 << 18
#: Rows of one feature that meet in one task; a feature of more is dealt over several, by pairs of its parts.
_TOGETHER = 4096


def _similar_sets(sets: DataFrame, key: str, least: float) -> DataFrame:
    """a < b, inter, jaccard of ``least`` (over 0) or more; each pair is made once, where its rarest common feature lies.

    Features are numbered from rare to frequent. Two sets of Jaccard j share at least j / (1 + j) * (na + nb), so they meet at
    a place in both lists behind which so many can still follow. Rows carry their whole set and a bitmap of it: bits of one
    that the other lacks bound what they share, and what passes is counted there, so candidates are never shuffled.
    """
    sets = durable(sets.select(key, "f"))
    rank = global_rank(sets.groupBy("f").agg(_count("df")), ["df", "f"])
    coded = sets.join(rank.select("f", F.col("rank").cast("int").alias("r")), "f")
    lists = durable(coded.groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("fs")).withColumn("n", F.size("fs")))  # one set is one row
    mean, total = lists.agg(F.coalesce(F.avg("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = [f"w{k}" for k in range(min(8, max(4, 1 << int(mean / 2.5).bit_length())))]

    def word(k: int) -> Column:
        bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.floor(r / len(words)), F.lit(64)).cast("int"))
        return F.aggregate("fs", F.lit(0).cast("bigint"), lambda acc, r: F.when(r % len(words) == k, acc.bitwiseOR(bit(r))).otherwise(acc)).alias(words[k])

    rows = lists.select(key, "n", "fs", *[word(k) for k in range(len(words))])
    shown = F.posexplode(F.slice("fs", F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)).alias("at", "f")
    # of features that more rows have than this there are fewer than 2^14
    crowd = max(_TOGETHER, -(-total >> 14))
    hot = durable(lists.select("n", "fs").select(shown).groupBy("f").agg(_count("rows")).where(F.col("rows") > crowd))
    parts = F.coalesce(F.ceil(F.col("rows") / F.lit(_TOGETHER)), F.lit(1)).cast("int")
    placed = rows.select("*", shown).join(F.broadcast(hot), "f", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def side(df: DataFrame, e: str) -> DataFrame:
        return df.select("f", "p", "q", F.col(key).alias(e), *[F.col(c).alias(f"{e}_{c}") for c in ("n", "at", "fs", *words)])

    a = side(placed.withColumn("p", F.col("own")).withColumn("q", every), "a")
    b = side(placed.withColumn("q", F.col("own")).withColumn("p", every), "b")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    follow = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    near = (F.col("a_n") >= F.col("b_n") * least) & (F.col("b_n") >= F.col("a_n") * least) & (follow >= need)

    lacks = [F.bit_count(F.col(f"a_{w}").bitwiseAND(F.bitwise_not(F.col(f"b_{w}")))) for w in words]
    alike = F.col("a_n") - sum(lacks[1:], lacks[0]) >= need
    common = F.array_intersect("a_fs", "b_fs")
    # in this order: most candidates share too little, so their common features are looked for once
    enough = F.size(common) >= need
    met = a.join(b, ["f", "p", "q"]).where((F.col("a") < F.col("b")) & near & alike & enough & (F.get(common, F.lit(0)) == F.col("f")))
    inter = met.select("a", "b", F.size(common).cast("bigint").alias("inter"), "a_n", "b_n")
    return inter.select("a", "b", "inter", (F.col("inter") / (F.col("a_n") + F.col("b_n") - F.col("inter"))).alias("jaccard")).where(F.col("jaccard") >= least)


def _every_pair(ents: DataFrame) -> DataFrame:
    """All pairs of conversations with entities: what a threshold of 0 asks for."""
    convs = ents.select("conv_id").distinct()
    return convs.select(F.col("conv_id").alias("a")).join(convs.select(F.col("conv_id").alias("b")), F.col("a") < F.col("b"))


def _weighted_pairs(ents: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """a, b, score: 0.7 of the entity sets' Jaccard and 0.3 of the keyword sets', of conversations that have entities.

    A weighted mean of ``least`` has a part of at least ``least``, so each part finds its candidates under the same threshold,
    and a pair that shares keywords alone is met as well. Both parts are then worked out from the sets themselves.
    """
    keys = keys.join(ents.select("conv_id").distinct(), "conv_id", "left_semi")
    if least <= 0:
        pairs = _every_pair(ents)
    else:
        found = [_similar_sets(x, "conv_id", least - 1e-6).select("a", "b") for x in (ents, keys)]
        pairs = found[0].union(found[1]).distinct()
    es = ents.groupBy("conv_id").agg(F.collect_set("f").alias("e"))
    ks = keys.groupBy("conv_id").agg(F.collect_set("f").alias("k"))
    sets = durable(es.join(ks, "conv_id", "left").withColumn("k", F.coalesce("k", F.array().cast("array<string>"))))
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("conv_id").alias(end), F.col("e").alias(f"e{end}"), F.col("k").alias(f"k{end}")), end)

    def jaccard(x: str) -> Column:
        common = F.size(F.array_intersect(f"{x}a", f"{x}b"))
        every = F.size(f"{x}a") + F.size(f"{x}b") - common
        return F.when(every > 0, common / every).otherwise(0.0)

    return pairs.select("a", "b", (0.7 * jaccard("e") + 0.3 * jaccard("k")).alias("score"))


def conversation_similarity(g: Graph, least: float = 0.3, top: int | None = None, keywords: bool = False) -> DataFrame:
    """a, b, score: Jaccard of entity sets, or 0.7 of it and 0.3 of the keywords'. ``least`` <= 0 adds disjoint pairs with score 0."""
    ents, keys = _features(g)
    if keywords:
        ents, keys = durable(ents), durable(keys)
        for bound in (0.4, 0.1) if ents.count() > _MANY else ():
            # if so many pairs reach a higher bound, the best are among them, and few others are looked at
            if not top or bound <= least:
                break
            found = durable(_weighted_pairs(ents, keys, bound).withColumn("score", F.round("score", 6)).where(F.col("score") >= bound))
            if found.count() >= top:
                return found.orderBy(F.desc("score"), "a", "b").limit(top)
        pairs = _weighted_pairs(ents, keys, least)
    else:
        pairs = _jaccard_pairs(ents, "conv_id", least).select("a", "b", F.col("jaccard").alias("score"))
        if least <= 0:
            pairs = _every_pair(ents).join(pairs, ["a", "b"], "left").fillna(0.0, ["score"])
    out = pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), "a", "b").limit(top) if top else out


def similar_conversations(g: Graph, conv_id: str, top: int = 10, least: float = 0.0) -> DataFrame:
    """Other conversations by Jaccard of entity sets; the query's set is joined, not compared pair by pair."""
    ents, _ = _features(g)
    mine = ents.where(F.col("conv_id") == conv_id).select("f")
    size = mine.agg(_count("mine"))
    others = ents.where(F.col("conv_id") != conv_id)
    inter = others.join(mine, "f").groupBy("conv_id").agg(_count("inter"))
    n = others.groupBy("conv_id").agg(_count("n"))
    scored = inter.join(n, "conv_id").join(F.broadcast(size)).select("conv_id", F.round(F.col("inter") / (F.col("n") + F.col("mine") - F.col("inter")), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "conv_id").limit(top)


def cross_links(g: Graph, least: float = 0.3) -> DataFrame:
    """msg_a < msg_b whose entities and keywords overlap: similarity at least ``least``; no cap on comparisons."""
    f = g.mentions.select("msg_id", F.col("entity_id").alias("f")).unionByName(g.keywords.select("msg_id", F.col("keyword_id").alias("f"))).distinct()
    p = _jaccard_pairs(f, "msg_id", least)
    return p.where(F.col("jaccard") >= least).select(F.col("a").alias("msg_a"), F.col("b").alias("msg_b"), F.round("jaccard", 6).alias("similarity"))


def similar_messages(links: DataFrame, msg_id: str, top: int = 20) -> DataFrame:
    """Both directions of the cross links of one message."""
    a = links.where(F.col("msg_a") == msg_id).select(F.col("msg_b").alias("msg_id"), "similarity")
    b = links.where(F.col("msg_b") == msg_id).select(F.col("msg_a").alias("msg_id"), "similarity")
    return a.union(b).distinct().orderBy(F.desc("similarity"), "msg_id").limit(top)


def conversation_topics(g: Graph, fraction: float = 0.3, least: int = 2) -> DataFrame:
    """Entities in at least ``fraction`` of a conversation's messages and ``least`` of them."""
    size = g.contains.groupBy("conv_id").agg(_count("size"))
    return (
        conversation_entities(g).join(size, "conv_id").select("conv_id", "entity_id", "n", F.round(F.col("n") / F.col("size"), 6).alias("weight"))
        .where((F.col("weight") >= fraction) & (F.col("n") >= least)).select("conv_id", "entity_id", "weight")
    )


# queries by words


def query_messages(g: Graph, query: str, top: int = 50) -> DataFrame:
    """Score of a message: the scores of the distinct entities and keywords it holds that match a term of the query."""
    terms = query_terms(query)
    named = g.names
    ents = named.where("label = 'Entity'").select("id", name_score(F.col("name"), terms).alias("s")).where("s > 0")
    keys = named.where("label = 'Keyword'").select("id", name_score(F.col("name"), terms, edges=False).alias("s")).where("s > 0")
    hits = g.mentions.join(ents, F.col("entity_id") == F.col("id")).select("msg_id", "s").unionAll(
        g.keywords.join(keys, F.col("keyword_id") == F.col("id")).select("msg_id", "s")
    )
    best = hits.groupBy("msg_id").agg(F.round(F.sum("s"), 4).alias("score")).orderBy(F.desc("score"), "msg_id").limit(top)
    return with_message(g, best).select("msg_id", "score", "role", "conv_id")


def semantic_search(g: Graph, query: str, top: int = 20, topics: bool = True) -> DataFrame:
    """One point per (term, entity) and (term, keyword) of a message, and half the topic weight for its conversation's topics."""
    terms = query_terms(query)
    ents = g.names.where("label = 'Entity'").select("id", name_score(F.col("name"), terms, edges=False).alias("s")).where("s > 0")
    keys = g.names.where("label = 'Keyword'").select("id", name_score(F.col("name"), terms, edges=False).alias("s")).where("s > 0")
    parts = g.mentions.join(ents, F.col("entity_id") == F.col("id")).select("msg_id", "s").unionAll(
        g.keywords.join(keys, F.col("keyword_id") == F.col("id")).select("msg_id", "s")
    )
    if topics:
        t = conversation_topics(g).join(ents, F.col("entity_id") == F.col("id")).select("conv_id", (0.5 * F.col("weight") * F.col("s")).alias("s"))
        parts = parts.unionAll(t.join(g.contains, "conv_id").select("msg_id", "s"))
    return parts.groupBy("msg_id").agg(F.round(F.sum("s"), 8).alias("score")).orderBy(F.desc("score"), "msg_id").limit(top)


def llm_context(results: DataFrame, budget: int = 50_000) -> DataFrame:
    """Per conversation the texts of (conv_id, msg_id, score, role, text) in order of score, as far as the budget goes."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"), F.lit("\n"))
    by_score = Window.orderBy(F.desc("score"), "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = results.withColumn("line", line).withColumn("used", F.sum(F.length("line")).over(by_score)).where(F.col("used") <= budget)
    return kept.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "msg_id", "line"))), lambda x: x["line"]), "").alias("context")
    )


def ask(contexts: DataFrame, question: str, call: Callable[[str, str], str]) -> DataFrame:
    """(conv_id, answer) of (conv_id, context): ``call(question, context)`` per row, in the tasks; a failing call gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(context: str) -> str | None:
            try:
                return call(question, context)
            except Exception:  # a model's failure is an answer of its own
                return None

        for f in frames:
            yield pd.DataFrame({"conv_id": f["conv_id"], "answer": [one(c) for c in f["context"]]})

    return contexts.select("conv_id", "context").mapInPandas(run, "conv_id string, answer string")


# neighbourhood


def related_entities(g: Graph, entity_id: str, top: int = 20) -> DataFrame:
    mine = g.mentions.where(F.col("entity_id") == entity_id).select("msg_id")
    others = g.mentions.join(mine, "msg_id", "left_semi").where(F.col("entity_id") != entity_id)
    return others.groupBy("entity_id").agg(_count("co_mentions")).orderBy(F.desc("co_mentions"), "entity_id").limit(top)


def neighborhood(g: Graph, entity_id: str, related: int = 20, convs: int = 10) -> DataFrame:
    """kind, id, n: the entity's messages, related entities by co-mentions, and conversations by message count."""
    msgs = g.mentions.where(F.col("entity_id") == entity_id).select("msg_id")
    size = g.contains.groupBy("conv_id").agg(_count("n"))
    own = g.contains.join(msgs, "msg_id", "left_semi").select("conv_id").distinct().join(size, "conv_id").orderBy("conv_id").limit(convs)
    return (
        msgs.select(F.lit("message").alias("kind"), F.col("msg_id").alias("id"), F.lit(1).cast("bigint").alias("n"))
        .unionByName(related_entities(g, entity_id, related).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("co_mentions").alias("n")))
        .unionByName(own.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "n"))
    )


# two graphs


def diff_counts(a: Graph, b: Graph) -> DataFrame:
    """kind, left_only, right_only, shared, jaccard for entities, keywords and conversations."""
    out = None
    for label in ("Entity", "Keyword", "Conversation"):
        x, y = a.of(label).select("id", F.lit(1).alias("l")).distinct(), b.of(label).select("id", F.lit(1).alias("r")).distinct()
        both = x.join(y, "id", "full_outer").agg(
            F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
            F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"),
        )
        total = F.col("left_only") + F.col("right_only") + F.col("shared")
        row = both.select(F.lit(label).alias("kind"), "*", F.coalesce(F.round(F.col("shared") / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("jaccard"))
        out = row if out is None else out.unionByName(row)
    return out


def diff_mentions(a: Graph, b: Graph, top: int = 30) -> DataFrame:
    """Entities by how far their mention counts differ, and to which side they lean."""
    x = mention_counts(a).withColumnRenamed("mentions", "n_left")
    y = mention_counts(b).withColumnRenamed("mentions", "n_right")
    z = x.join(y, "entity_id", "full_outer").fillna(0, ["n_left", "n_right"])
    lean = F.when(F.col("n_left") > F.col("n_right"), "left").when(F.col("n_left") < F.col("n_right"), "right").otherwise("equal")
    return z.select("entity_id", "n_left", "n_right", F.abs(F.col("n_left") - F.col("n_right")).alias("diff"), lean.alias("lean")).orderBy(
        F.desc("diff"), "entity_id"
    ).limit(top)


def diff_types(a: Graph, b: Graph) -> DataFrame:
    def side(g: Graph, col: str) -> DataFrame:
        t = g.names.where("label = 'Entity'").select(F.col("id").alias("entity_id"), "entity_type")
        return mention_counts(g).join(t, "entity_id").groupBy("entity_type").agg(F.sum("mentions").alias(col))

    return side(a, "n_left").join(side(b, "n_right"), "entity_type", "full_outer").fillna(0, ["n_left", "n_right"])


# enrichment


def entity_enrichment(g: Graph) -> DataFrame:
    """id, mention_count of every entity."""
    e = g.of("Entity").select("id")
    return e.join(mention_counts(g).withColumnRenamed("entity_id", "id"), "id", "left").select("id", F.coalesce("mentions", F.lit(0)).cast("bigint").alias("mention_count"))


def keyword_enrichment(g: Graph) -> DataFrame:
    return g.keywords.groupBy(F.col("keyword_id").alias("id")).agg(_count("document_frequency"), F.round(F.avg("weight"), 7).alias("avg_tfidf"))


def backfill_times(g: Graph, times: DataFrame) -> DataFrame:
    """Nodes with create_time filled from (id, create_time) where it is null."""
    t = times.select("id", F.col("create_time").alias("_t"))
    return g.nodes.join(t, "id", "left").withColumn("create_time", F.coalesce("create_time", "_t")).drop("_t")

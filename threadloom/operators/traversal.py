"""Reply chains and reachability. Loops run on the driver, one distributed step per level or doubling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.graph import Graph
from threadloom.session import durable, release


def ancestors(replies: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, distance): the transitive closure of parent_id -> child_id by doubling; cycles settle as well."""
    known = durable(replies.select(F.col("child_id").alias("node"), F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    size = known.count()
    for _ in range(most):
        far = known.alias("x").join(known.alias("y"), F.col("x.ancestor") == F.col("y.node")).select(
            "x.node", "y.ancestor", (F.col("x.distance") + F.col("y.distance")).alias("distance")
        )
        known = durable(known.unionByName(far).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        now = known.count()
        if now == size:
            break
        size = now
    return known


def _tree(replies: DataFrame) -> DataFrame | None:
    """Distinct (parent_id, child_id), written once, if no child has two parents."""
    e = durable(replies.select("parent_id", "child_id").where("parent_id is not null and child_id is not null").distinct())
    return e if e.groupBy("child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() else None


def _climb(e: DataFrame, sizes: bool = False) -> DataFrame | None:
    """(id, up, down) of every child and parent in a forest: ancestors and, with ``sizes``, descendants.

    Pointers to an ancestor double their reach each round, so a chain of d messages takes log2(d) rounds of one row a message,
    not d rounds or d^2 pairs. None if a cycle keeps pointers from ever reaching a root.
    """
    ids = e.select(F.col("child_id").alias("id")).union(e.select("parent_id")).distinct()
    start = ids.join(e.withColumnRenamed("child_id", "id"), "id", "left")
    now = durable(start.select("id", F.col("parent_id").alias("to"), F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("down")))
    left = now.where("to is not null").count()
    most = now.count()
    reach = 1
    while left:
        if reach > most:  # a chain is shorter than the number of messages
            return None
        if sizes:
            # ``down`` counts descendants less than ``reach`` away; those below a pointer's start add the next ones
            gained = now.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum(1 + F.col("down")).alias("more"))
            now = now.join(gained, "id", "left").withColumn("down", F.col("down") + F.coalesce("more", F.lit(0))).drop("more")
        over = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("up").alias("_up"))
        # messages that have reached their root stay where they are, so no key gathers them
        moved = now.where("to is not null").join(over, "to").select("id", F.col("_to").alias("to"), (F.col("up") + F.col("_up")).alias("up"), "down")
        now = durable(now.where("to is null").select("id", "to", "up", "down").unionByName(moved))
        left = now.where("to is not null").count()
        reach *= 2
    return now.select("id", "up", "down")


def ancestor_counts(g: Graph) -> DataFrame:
    """Distinct ancestors of every message; a root has 0. Forests are climbed by doubling, other graphs take the closure."""
    e = _tree(g.replies)
    found = _climb(e) if e is not None else None
    if found is not None:
        n = found.select("id", F.col("up").alias("depth"))
    else:
        n = ancestors(g.replies).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("depth"))
    return g.of("Message").select("id").join(n, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def longest_depth(nodes: DataFrame, replies: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, depth): messages on the longest chain from a root, root = 1.

    Forests are climbed by doubling; where a message has two parents or stands on a cycle it takes one step per level.
    Members of a cycle that no root reaches never come up and are left out, as no order exists for them. Raises if the steps
    go on after ``most`` levels, as on a cycle that a root reaches.
    """
    tree = _tree(replies)
    climbed = _climb(tree) if tree is not None else None
    if climbed is not None:
        # the chain starts at a root that is one of ``nodes``, as in the steps below
        up = nodes.select("id").distinct().join(climbed.select("id", "up"), "id", "left")
        heads = up.where(F.coalesce("up", F.lit(0)) == 0)
        missing = climbed.where("up = 0").join(heads.select("id"), "id", "left_anti")
        if missing.isEmpty():
            inner = climbed.where("up > 0").select("id", (F.col("up") + 1).cast("int").alias("depth"))
            return durable(heads.select("id", F.lit(1).alias("depth")).unionByName(inner))
    waiting = durable(replies.select("parent_id", "child_id").distinct())
    heads = nodes.select("id").join(waiting.select(F.col("child_id").alias("id")).distinct(), "id", "left_anti")
    done = durable(heads.withColumn("depth", F.lit(1)))
    level = done
    for step in range(2, most + 2):
        # a node's depth is the last level at which one of its parents hands over
        nxt = waiting.join(level, waiting["parent_id"] == level["id"]).select(F.col("child_id").alias("id")).distinct()
        level = durable(nxt.withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    else:
        raise RuntimeError(f"reply chains go on after {most} levels")
    return durable(done.groupBy("id").agg(F.max("depth").alias("depth")))


def depth_by_conversation(g: Graph) -> DataFrame:
    """conv_id, max_depth, mean_depth, messages, branching: mean children over the conversation's parents."""
    d = longest_depth(g.of("Message"), g.replies)
    kids = g.replies.groupBy(F.col("parent_id").alias("msg_id")).agg(F.count(F.lit(1)).alias("kids"))
    rows = g.contains.join(d, F.col("msg_id") == F.col("id")).join(kids, "msg_id", "left")
    return rows.groupBy("conv_id").agg(
        F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("mean_depth"), F.count(F.lit(1)).alias("messages"),
        F.round(F.coalesce(F.avg("kids"), F.lit(0.0)), 4).alias("branching"),
    )


def depth_distribution(g: Graph) -> DataFrame:
    """conv_id, distribution as ``1:3 2:2``."""
    d = longest_depth(g.of("Message"), g.replies)
    n = g.contains.join(d, F.col("msg_id") == F.col("id")).groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    items = F.sort_array(F.collect_list(F.struct("depth", "n")))
    return n.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["depth"], x["n"])), " ").alias("distribution"))


def depth_histogram(g: Graph) -> DataFrame:
    return longest_depth(g.of("Message"), g.replies).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def conversation_meta(g: Graph, names: int = 5) -> DataFrame:
    """Per conversation: ancestor depth (max, mean), most children, messages, and its dominant entities."""
    from threadloom.operators.relational import top_conversation_entities

    d = ancestor_counts(g)
    kids = g.replies.groupBy(F.col("parent_id").alias("msg_id")).agg(F.count(F.lit(1)).alias("kids"))
    base = g.contains.join(d, F.col("msg_id") == F.col("id")).join(kids, "msg_id", "left").groupBy("conv_id").agg(
        F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("mean_depth"),
        F.coalesce(F.max("kids"), F.lit(0)).cast("bigint").alias("branching_factor"), F.count(F.lit(1)).alias("message_count"),
    )
    named = top_conversation_entities(g, names).join(g.names.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    listed = named.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("dominant_entities")
    )
    return base.join(listed, "conv_id", "left").fillna("", ["dominant_entities"])


def message_centrality(g: Graph) -> DataFrame:
    """Betweenness of messages; replies form a forest, so it is ancestors times descendants, exactly."""
    e = _tree(g.replies)
    found = _climb(e, sizes=True) if e is not None else None
    if found is not None:
        up, down = found.select("id", "up"), found.select("id", "down")
    else:
        pairs = ancestors(g.replies)
        up = pairs.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("up"))
        down = pairs.groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("down"))
    return g.of("Message").select("id").join(up, "id", "left").join(down, "id", "left").select(
        "id", (F.coalesce("up", F.lit(0)) * F.coalesce("down", F.lit(0))).cast("double").alias("betweenness")
    )


def reply_stats(g: Graph, conv_id: str) -> DataFrame:
    """Depth figures of one conversation over messages with a reply edge inside it."""
    own = g.contains.where(F.col("conv_id") == conv_id).select("msg_id")
    e = g.replies.join(own.select(F.col("msg_id").alias("parent_id")), "parent_id", "left_semi").join(
        own.select(F.col("msg_id").alias("child_id")), "child_id", "left_semi"
    ).select("parent_id", "child_id")
    nodes = e.select(F.col("parent_id").alias("id")).union(e.select(F.col("child_id").alias("id"))).distinct()
    d = longest_depth(nodes, e)
    kids = e.groupBy("parent_id").agg(F.count(F.lit(1)).alias("kids")).agg(F.round(F.coalesce(F.avg("kids"), F.lit(0.0)), 4).alias("branching"))
    return d.agg(F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("mean_depth"), F.count(F.lit(1)).alias("messages")).join(F.broadcast(kids))


def context(g: Graph, msg_id: str, depth: int = 3) -> DataFrame:
    """(id, hop): up to ``depth`` ancestors (negative hops), the message (0) and descendants (positive hops)."""
    spark = g.spark
    out = spark.createDataFrame([(msg_id, 0)], "id string, hop int").join(g.of("Message").select("id"), "id", "left_semi")
    up = down = out
    for k in range(1, depth + 1):
        up = g.replies.join(up.select(F.col("id").alias("child_id")), "child_id").select(F.col("parent_id").alias("id"), F.lit(-k).alias("hop")).distinct()
        down = g.replies.join(down.select(F.col("id").alias("parent_id")), "parent_id").select(F.col("child_id").alias("id"), F.lit(k).alias("hop")).distinct()
        out = out.unionByName(up).unionByName(down)
    return out.groupBy("id").agg(F.min_by("hop", F.abs("hop")).alias("hop"))


def conversation_order(g: Graph, conv_id: str) -> DataFrame:
    """(msg_id, level, place): breadth first from the roots, siblings by id; messages without an order come last."""
    own = g.contains.where(F.col("conv_id") == conv_id).select("msg_id").distinct()
    e = g.replies.join(own.select(F.col("msg_id").alias("child_id")), "child_id", "left_semi").join(own.select(F.col("msg_id").alias("parent_id")), "parent_id", "left_semi")
    d = longest_depth(own.withColumnRenamed("msg_id", "id"), e)
    placed = own.join(d, F.col("msg_id") == F.col("id"), "left").select("msg_id", F.coalesce("depth", F.lit(1 << 30)).alias("level"))
    return placed.withColumn("place", F.row_number().over(Window.orderBy("level", "msg_id")))  # one conversation


def traverse(similar: DataFrame, bridges: DataFrame | Callable[[DataFrame], DataFrame], start: str, hops: int = 2, top: int = 5) -> DataFrame:
    """(entity_id, hop, via): breadth first over the best ``top`` similar nodes and bridges of each entity.

    similar: (source, target, score); bridges: (entity_a, entity_b, betweenness), or a function that gives those rows for
    ids (id), so that only the bridges of entities on the way are worked out.
    """
    of = bridges if callable(bridges) else lambda ids: bridges.join(ids.withColumnRenamed("id", "entity_a"), "entity_a", "left_semi")
    best = lambda df, key, score: df.withColumn(
        "_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "target"))
    ).where(F.col("_k") <= top).drop("_k")
    seen = durable(similar.sparkSession.createDataFrame([(start, 0, "start")], "entity_id string, hop int, via string"))
    front = seen
    for k in range(1, hops + 1):
        ids = front.select(F.col("entity_id").alias("id"))
        s = best(similar.join(ids.withColumnRenamed("id", "source"), "source", "left_semi"), "source", "score").select("source", "target", F.lit("similar").alias("via"))
        b = best(of(ids).select(F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), "betweenness"), "source", "betweenness")
        edges = s.unionByName(b.select("source", "target", F.lit("bridge").alias("via")))
        nxt = edges.groupBy(F.col("target").alias("entity_id")).agg(F.min("via").alias("via"))
        front = durable(nxt.join(seen, "entity_id", "left_anti").select("entity_id", F.lit(k).alias("hop"), "via"))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def components(edges: DataFrame, nodes: DataFrame | None = None, most: int = 100) -> DataFrame:
    """(id, component): smallest reachable id over undirected (a, b); star contraction, so rounds grow with the logarithm."""
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, durable(small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(old)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000000007))")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

"""Canonical graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.graph import Graph, build, pairs_of

DAY = 86400.0


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``conversations``; a turn answers turn (turn - 1) div 2, so chains branch; one day per turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ident = lambda turn: F.concat(F.lit("m"), "conv_id", F.lit("_"), turn)
    before = F.floor((F.col("turn") - 1) / 2).cast("bigint")
    return t.select(
        ident(F.col("turn")).alias("id"), "role", "text", F.when(F.col("turn") > 0, ident(before)).alias("parent"),
        ((F.col("conv_id") * 8 + F.col("turn")) * F.lit(DAY)).cast("double").alias("create_time"),
        F.concat(F.lit("c"), "conv_id").alias("conversation_id"), F.lit("en").alias("lang"),
    )


def chat(spark: SparkSession, sf_dir: str) -> Graph:
    return build(chat_messages(spark, sf_dir))


def chat_untimed(spark: SparkSession, sf_dir: str) -> Graph:
    """The chat graph, but conversations of numbers divisible by three have no times."""
    m = chat_messages(spark, sf_dir)
    return build(m.withColumn("create_time", F.when(F.substring("conversation_id", 2, 20).cast("bigint") % 3 != 0, F.col("create_time"))))


def chat_half(spark: SparkSession, sf_dir: str, odd: bool) -> Graph:
    """The graph of the conversations with even or odd numbers, for comparisons of two graphs."""
    m = chat_messages(spark, sf_dir)
    return build(m.where(F.substring("conversation_id", 2, 20).cast("bigint") % 2 == int(odd)))


def chat_part(spark: SparkSession, sf_dir: str, left_out: int) -> Graph:
    """The graph of the conversations whose numbers leave another rest than ``left_out`` when divided by three."""
    m = chat_messages(spark, sf_dir)
    return build(m.where(F.substring("conversation_id", 2, 20).cast("bigint") % 3 != left_out))


def basket(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers as conversations, orders as messages, parts as entities (typed by brand), part types as keywords."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    ident = F.concat(F.lit("entity::"), "p_brand", F.lit("::"), "p_name", F.lit("_"), "p_partkey")
    named = parts.select("p_partkey", ident.alias("entity_id"), "p_name", "p_brand", "p_type")
    sold = lines.join(named, F.col("l_partkey") == F.col("p_partkey"))
    msg = F.concat(F.lit("o"), "l_orderkey").alias("msg_id")
    mentions = sold.select(msg, "entity_id").distinct()
    keywords = sold.groupBy(msg, F.concat(F.lit("keyword::"), "p_type").alias("keyword_id")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = orders.select("o_orderkey", prev.alias("prev")).where("prev is not null")
    none = F.lit("")
    nodes = (
        orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("Message").alias("label"), none.alias("role"), none.alias("text"), none.alias("name"), none.alias("entity_type"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("create_time"))
        .unionByName(orders.select(F.concat(F.lit("u"), "o_custkey").alias("id")).distinct().select("id", F.lit("Conversation").alias("label"), none.alias("role"), none.alias("text"), none.alias("name"), none.alias("entity_type"), F.lit(None).cast("double").alias("create_time")))
        .unionByName(named.select(F.col("entity_id").alias("id"), F.lit("Entity").alias("label"), none.alias("role"), none.alias("text"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), F.lit(None).cast("double").alias("create_time")))
        .unionByName(parts.select(F.concat(F.lit("keyword::"), "p_type").alias("id"), F.col("p_type").alias("name")).distinct().select("id", F.lit("Keyword").alias("label"), none.alias("role"), none.alias("text"), "name", none.alias("entity_type"), F.lit(None).cast("double").alias("create_time")))
    )
    return Graph(
        nodes=nodes,
        contains=orders.select(F.concat(F.lit("u"), "o_custkey").alias("conv_id"), F.concat(F.lit("o"), "o_orderkey").alias("msg_id")),
        replies=chain.select(F.concat(F.lit("o"), "prev").alias("parent_id"), F.concat(F.lit("o"), "o_orderkey").alias("child_id")),
        mentions=mentions,
        cooc=pairs_of(mentions),
        keywords=keywords,
    )


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def chat_sql(where: str = "true") -> str:
    """The same graph for DuckDB, of the rows for which ``where`` holds: CTEs msgs, mfull, mentions, contains, replies, cooc, keywords, nodes."""
    from threadloom.operators.text import STOP_WORDS

    return rf"""
with recursive msgs as (select 'm' || conv_id || '_' || turn as id, role, text, case when turn > 0 then 'm' || conv_id || '_' || ((turn - 1) // 2) end as parent,
    ((conv_id * 8 + turn) * 86400)::double as create_time, 'c' || conv_id as conv_id, conv_id as cn from conversations where {where}),
toks as (select id as msg_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')) as w from msgs),
caps as (select msg_id, w, case when length(w) <= 6 then 'ORG' when length(w) <= 9 then 'PERSON' else 'PLACE' end as typ from toks where regexp_matches(w, '^\p{{Lu}}\p{{Ll}}{{3,}}$')),
mfull as (select msg_id, 'entity::' || typ || '::' || lower(w) as entity_id, min(w) as name, min(typ) as entity_type from caps group by 1, 2),
mentions as (select msg_id, entity_id from mfull),
contains as (select conv_id, id as msg_id from msgs),
replies as (select parent as parent_id, id as child_id from msgs where parent in (select id from msgs)),
cooc as (select a.entity_id as entity_a, b.entity_id as entity_b, count(*) as weight from mentions a join mentions b on a.msg_id = b.msg_id and a.entity_id < b.entity_id group by 1, 2),
terms as (select id as doc, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) as term from msgs),
tf as (select doc, term, count(*) as tf from terms where length(term) >= 2 and term not in ({_words(STOP_WORDS)}) group by 1, 2),
vocab as (select term, count(*) as df, sum(tf) as cf from tf group by 1 order by cf desc, term limit 5000),
wraw as (select doc, tf.term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from msgs)) / (1 + df)) + 1) as w from tf join vocab using (term)),
wl as (select doc, term, round(w / sqrt(sum(w * w) over (partition by doc)), 6) as weight from wraw),
wk as (select doc as msg_id, 'keyword::' || term as keyword_id, term, weight, row_number() over (partition by doc order by weight desc, term) as k from wl),
keywords as (select msg_id, keyword_id, weight from wk where k <= 5),
ents as (select entity_id as id, min(name) as name, min(entity_type) as entity_type from mfull group by 1),
keys as (select distinct keyword_id as id, term as name from wk where k <= 5),
nodes as (select distinct conv_id as id, 'Conversation' as label, '' as role, '' as text, '' as name, '' as entity_type, null::double as create_time from msgs
  union all select id, 'Message', role, left(text, 1000), '', '', create_time from msgs
  union all select id, 'Entity', '', '', name, entity_type, null from ents union all select id, 'Keyword', '', '', name, '', null from keys),
mc as (select entity_id, count(*) as mentions from mentions group by 1),
ce as (select conv_id, entity_id, count(*) as n from mentions join contains using (msg_id) group by 1, 2),
tope as (select entity_id from mc order by mentions desc, entity_id limit 1),
tope2 as (select entity_id from mc order by mentions desc, entity_id limit 1 offset 1),
topk as (select keyword_id from keywords group by 1 order by count(*) desc, keyword_id limit 1),
mt as (select m.entity_id, x.create_time from mentions m join msgs x on x.id = m.msg_id),
bk as (select strftime(make_timestamp((create_time * 1000000)::bigint), '%Y-%m') as bucket, entity_id, count(*) as n from mt group by 1, 2)
"""

"""Registered queries over the chat graph, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.graph import Graph
from threadloom.operators import algorithms as A
from threadloom.operators import relational as R
from threadloom.operators import temporal as T
from threadloom.operators import text as X
from threadloom.operators import traversal as V
from threadloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def graph_query(name: str, sql: str | None = None):
    """Registers a function of the chat graph."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(views.chat(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.chat_sql() + sql
        return f

    return add


def table_query(name: str, sql: str | None = None, graph_sql: bool = False):
    """Registers a function of the session and the input folder."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (views.chat_sql() if graph_sql else "") + sql
        return f

    return add


def top_entity(g: Graph, place: int = 0) -> str:
    rows = R.mention_counts(g).orderBy(F.desc("mentions"), "entity_id").limit(place + 1).collect()
    return rows[place]["entity_id"] if len(rows) > place else ""


def top_keyword(g: Graph) -> str:
    r = R.keyword_stats(g).orderBy(F.desc("n"), "keyword_id").first()
    return r["keyword_id"] if r else ""


# scans
graph_query("scan_all_edges", "select 'm' as kind, msg_id as a, entity_id as b from mentions union all select 'c', conv_id, msg_id from contains union all select 'r', parent_id, child_id from replies union all select 'o', entity_a, entity_b from cooc union all select 'k', msg_id, keyword_id from keywords")(
    lambda g: g.mentions.select(F.lit("m").alias("kind"), F.col("msg_id").alias("a"), F.col("entity_id").alias("b"))
    .unionAll(g.contains.select(F.lit("c"), "conv_id", "msg_id")).unionAll(g.replies.select(F.lit("r"), "parent_id", "child_id"))
    .unionAll(g.cooc.select(F.lit("o"), "entity_a", "entity_b")).unionAll(g.keywords.select(F.lit("k"), "msg_id", "keyword_id"))
)
graph_query("scan_by_label", "select id, name, entity_type from nodes where label = 'Entity'")(lambda g: g.of("Entity").select("id", "name", "entity_type"))
graph_query("point_lookup", "select id, label, role, text from nodes where id in ('m1_0', 'c1', 'nothing')")(lambda g: g.nodes.where(F.col("id").isin("m1_0", "c1", "nothing")).select("id", "label", "role", "text"))
graph_query("id_sets", "select id from nodes where label = 'Message'")(lambda g: g.of("Message").select("id"))
graph_query("ts_lookup", "select id, create_time from msgs where create_time is not null")(lambda g: g.of("Message").where("create_time is not null").select("id", "create_time"))
graph_query("gr_build", "select label, count(*) as n, sum(length(name)) as name_chars from nodes group by 1")(lambda g: g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("name")).alias("name_chars")))
graph_query("gr_cooc_graph", "select entity_a, entity_b, weight from cooc where weight >= 2")(lambda g: g.cooc.where("weight >= 2"))
graph_query("flt_min_weight", "select entity_a, entity_b, weight from cooc where weight >= 3")(lambda g: g.cooc.where("weight >= 3"))
graph_query("gr_reply_graph", "select parent_id, child_id from replies")(lambda g: g.replies)
graph_query("nlp_ner", "select msg_id, entity_id, name, entity_type from mfull")(
    lambda g: g.mentions.join(g.names.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id").select("msg_id", "entity_id", "name", "entity_type")
)
ORACLES["nlp_ner"] = views.chat_sql() + "select m.msg_id, m.entity_id, e.name, e.entity_type from mentions m join ents e on e.id = m.entity_id"
graph_query("agg_cooc_weight", "select entity_a, entity_b, weight from cooc")(lambda g: g.cooc)
graph_query("win_topk_keywords", "select msg_id, keyword_id, weight from keywords")(lambda g: g.keywords)

# aggregates
graph_query("agg_nodes_by_label", "select label, count(*) as n from nodes group by 1")(R.nodes_by_label)
_EDGES = "select 'CONTAINS' as {0}, count(*) as n from contains union all select 'REPLIES_TO', count(*) from replies union all select 'MENTIONS', count(*) from mentions union all select 'CO_OCCURS_WITH', count(*) from cooc union all select 'HAS_KEYWORD', count(*) from keywords"
graph_query("agg_edge_counts", _EDGES.format("edge"))(R.edge_counts)
graph_query(
    "agg_graph_stats",
    f"select 'total' as kind, 'nodes' as key, count(*) as n from nodes union all select 'label', label, count(*) from nodes group by 2 union all select 'edge', edge, n from ({_EDGES.format('edge')}) "
    "union all (select 'entity_type', entity_type, count(*) from ents where entity_type <> '' group by 2 order by 3 desc, 2 limit 20) union all select 'role', role, count(*) from msgs where role <> '' group by 2",
)(R.graph_stats)
graph_query("agg_mentions", "select entity_id, mentions from mc")(R.mention_counts)
graph_query("agg_keyword_stats", "select keyword_id, count(*) as n, round(sum(weight), 7) as total, round(avg(weight), 7) as avg_weight from keywords group by 1")(R.keyword_stats)
graph_query("agg_conv_entities", "select conv_id, entity_id, n from ce")(R.conversation_entities)
graph_query("win_topk_conv", "select * from (select conv_id, entity_id, n, row_number() over (partition by conv_id order by n desc, entity_id)::int as rank from ce) where rank <= 5")(R.top_conversation_entities)
graph_query("agg_degree", "select entity_id, count(*) as degree from (select entity_a as entity_id from cooc where weight >= 2 union all select entity_b from cooc where weight >= 2) group by 1")(lambda g: R.degree(g, 2))
graph_query("gr_topics", "select conv_id, entity_id, weight from (select conv_id, entity_id, n, round(n / size, 6) as weight from ce join (select conv_id, count(*) as size from contains group by 1) using (conv_id)) where weight >= 0.3 and n >= 2")(R.conversation_topics)
graph_query("agg_topic_fraction", "select conv_id, entity_id, weight from (select conv_id, entity_id, n, round(n / size, 6) as weight from ce join (select conv_id, count(*) as size from contains group by 1) using (conv_id)) where weight >= 0.1 and n >= 1")(lambda g: R.conversation_topics(g, 0.1, 1))
graph_query("agg_keyword_enrich", "select keyword_id as id, count(*) as document_frequency, round(avg(weight), 7) as avg_tfidf from keywords group by 1")(R.keyword_enrichment)
graph_query("agg_entity_pair_related", "select m.entity_id, count(*) as co_mentions from mentions m where m.msg_id in (select msg_id from mentions where entity_id = (from tope)) and m.entity_id <> (from tope) group by 1 order by 2 desc, 1 limit 20")(lambda g: R.related_entities(g, top_entity(g)))
graph_query("gr_enrich_mentions", "select id, coalesce(mentions, 0) as mention_count from ents left join mc on id = entity_id")(R.entity_enrichment)
graph_query("agg_set_union", "select conv_id, count(*) as n from (select conv_id, entity_id as f from ce union select conv_id, keyword_id from keywords join contains using (msg_id)) group by 1")(
    lambda g: R._features(g)[0].union(R._features(g)[1]).distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
)
graph_query("agg_count_distinct", "select role, count(distinct conv_id) as convs from msgs group by 1")(
    lambda g: g.of("Message").join(g.contains, F.col("id") == F.col("msg_id")).groupBy("role").agg(F.count_distinct("conv_id").alias("convs"))
)
graph_query("agg_min_max_ts", "select conv_id, min(create_time) as created, max(create_time) as updated from msgs group by 1")(
    lambda g: g.of("Message").join(g.contains, F.col("id") == F.col("msg_id")).groupBy("conv_id").agg(F.min("create_time").alias("created"), F.max("create_time").alias("updated"))
)

# search and ranking
_ENT = "select id, name, entity_type, coalesce(mentions, 0) as mention_count from ents left join mc on id = entity_id where {0} order by 4 desc, 1 limit {1}"
graph_query("srt_search_entities", _ENT.format("contains(lower(name), 'th')", 20))(lambda g: R.search_entities(g, "th"))
graph_query("srt_search_entities_typed", _ENT.format("contains(lower(name), 'e') and entity_type = 'PERSON'", 20))(lambda g: R.search_entities(g, "e", "person"))
graph_query("srt_top_entities", _ENT.format("true", 20))(R.top_entities)
_KEY = "select id, name, n, avg_weight from keys join (select keyword_id as id, count(*) as n, round(avg(weight), 7) as avg_weight from keywords group by 1) using (id) where {0} order by n desc, avg_weight desc, id limit 20"
graph_query("srt_search_keywords", _KEY.format("contains(name, 'an')"))(lambda g: R.search_keywords(g, "an"))
graph_query("srt_top_keywords", _KEY.format("true"))(R.top_keywords)
_MSG = "select x.msg_id, {0} coalesce(m.role, '') as role, coalesce(left(m.text, 500), '') as text, coalesce(m.conv_id, '') as conv_id from ({1}) x left join msgs m on m.id = x.msg_id"
graph_query("srt_keyword_messages", _MSG.format("x.weight,", "select msg_id, weight from keywords where keyword_id = (from topk) order by weight desc, msg_id limit 20"))(lambda g: R.keyword_messages(g, top_keyword(g)))
graph_query("srt_entity_messages", _MSG.format("", "select msg_id from mentions where entity_id = (from tope) order by 1 limit 50"))(lambda g: R.entity_messages(g, top_entity(g)))
graph_query("jn_node_attrs", _MSG.format("", "select msg_id from mentions where entity_id = (from tope2) order by 1 limit 50"))(lambda g: R.entity_messages(g, top_entity(g, 1)))
graph_query(
    "srt_cooccurring",
    "select c.entity_id, weight, name, entity_type from (select case when entity_a = (from tope) then entity_b else entity_a end as entity_id, weight from cooc where (from tope) in (entity_a, entity_b) order by 2 desc, 1 limit 20) c join ents on id = c.entity_id",
)(lambda g: R.cooccurring(g, top_entity(g)))
graph_query("flt_nodes", "select id, label, name, entity_type from nodes where label = 'Entity' and contains(lower(name), 'er') and upper(entity_type) = 'ORG' order by id limit 50")(lambda g: R.search_nodes(g, "Entity", "er", "org"))
graph_query(
    "flt_text_search",
    "select id as msg_id, role, place, (case when b > 1 then '...' else '' end) || substring(text, b, e - b) || (case when e <= length(text) then '...' else '' end) as snippet from (select id, role, left(text, 1000) as text, instr(lower(left(text, 1000)), 'the')::int as place, greatest(instr(lower(left(text, 1000)), 'the') - 80, 1) as b, least(instr(lower(left(text, 1000)), 'the') + 83, length(left(text, 1000)) + 1) as e from msgs) where place > 0 order by 1 limit 20",
)(lambda g: R.search_text(g, "The"))
graph_query("win_first_text", "select conv_id, left(arg_min(text, create_time), 60) as title from msgs where trim(text) <> '' group by 1")(R.conversation_titles)
graph_query("prj_truncate", "select id, left(text, 300) as text from msgs")(lambda g: g.of("Message").select("id", F.substring("text", 1, 300).alias("text")))

# joins and sets
graph_query("jn_mention_conv", "select conv_id, msg_id, entity_id from mentions join contains using (msg_id)")(lambda g: g.mentions.join(g.contains, "msg_id").select("conv_id", "msg_id", "entity_id"))
graph_query("jn_mention_ts", "select entity_id, create_time from mt")(lambda g: g.mentions.join(g.of("Message").select(F.col("id").alias("msg_id"), "create_time"), "msg_id", "left").select("entity_id", "create_time"))
graph_query("jn_conv_attr", "select msg_id, coalesce(conv_id, '') as conv_id from mentions left join contains using (msg_id)")(lambda g: g.mentions.join(g.contains, "msg_id", "left").select("msg_id", F.coalesce("conv_id", F.lit("")).alias("conv_id")))
graph_query("jn_induced_subgraph", "select parent_id, child_id from replies where parent_id in (select msg_id from contains where conv_id = 'c1') and child_id in (select msg_id from contains where conv_id = 'c1')")(
    lambda g: g.replies.join(g.contains.where("conv_id = 'c1'").select(F.col("msg_id").alias("parent_id")), "parent_id", "left_semi").join(g.contains.where("conv_id = 'c1'").select(F.col("msg_id").alias("child_id")), "child_id", "left_semi").select("parent_id", "child_id")
)
graph_query("jn_pairs_theta", "select a.msg_id, a.entity_id as a, b.entity_id as b from mentions a join mentions b on a.msg_id = b.msg_id and a.entity_id < b.entity_id")(
    lambda g: g.mentions.select("msg_id", F.col("entity_id").alias("a")).join(g.mentions.select("msg_id", F.col("entity_id").alias("b")), "msg_id").where("a < b")
)
_INTER = "(select x.{0} as a, y.{0} as b, count(*) as i from {1} x join {1} y on x.f = y.f and x.{0} < y.{0} group by 1, 2)"
_JAC = "select a, b, i / (na.n + nb.n - i) as j from {2} p join (select {0} as k, count(*) as n from {1} group by 1) na on na.k = a join (select {0} as k, count(*) as n from {1} group by 1) nb on nb.k = b"


def jac(key: str, sets: str) -> str:
    return _JAC.format(key, sets, _INTER.format(key, sets))


_ES, _KS = "(select conv_id, entity_id as f from ce)", "(select distinct conv_id, keyword_id as f from keywords join contains using (msg_id))"
graph_query("jn_allpairs", f"select a, b, round(j, 6) as score from ({jac('conv_id', _ES)}) where round(j, 6) >= 0.05")(lambda g: R.conversation_similarity(g, 0.05))
_WEIGHTED = f"""
select a, b, round(0.7 * coalesce(e.j, 0) + 0.3 * coalesce(k.j, 0), 6) as score
from ({jac('conv_id', _ES)}) e full join ({jac('conv_id', _KS)}) k using (a, b)
where a in (select conv_id from ce) and b in (select conv_id from ce)
  and round(0.7 * coalesce(e.j, 0) + 0.3 * coalesce(k.j, 0), 6) >= 0.02
order by 3 desc, 1, 2 limit 20"""
graph_query("gr_conv_similarity", _WEIGHTED)(lambda g: R.conversation_similarity(g, 0.02, 20, True))
graph_query("jn_one_vs_all", f"select case when a = 'c1' then b else a end as conv_id, round(j, 6) as score from ({jac('conv_id', _ES)}) where 'c1' in (a, b) order by 2 desc, 1 limit 10")(lambda g: R.similar_conversations(g, "c1"))
_FS = "(select msg_id, entity_id as f from mentions union select msg_id, keyword_id from keywords)"
graph_query("gr_cross_links", f"select a as msg_a, b as msg_b, round(j, 6) as similarity from ({jac('msg_id', _FS)}) where j >= 0.3")(R.cross_links)
graph_query("jn_candidate_pairs", f"select a as msg_a, b as msg_b, round(j, 6) as similarity from ({jac('msg_id', _FS)}) where j >= 0.1")(lambda g: R.cross_links(g, 0.1))
graph_query("set_union_dedup", f"with l as (select * from ({jac('msg_id', _FS)}) where j >= 0.1) select case when a = 'm1_0' then b else a end as msg_id, round(j, 6) as similarity from l where 'm1_0' in (a, b) order by 2 desc, 1 limit 20".replace("with l as", "select * from (with l as", 1) + ")")(lambda g: R.similar_messages(R.cross_links(g, 0.1), "m1_0"))
graph_query("set_union_features", f"select msg_id, count(*) as n from {_FS} group by 1")(
    lambda g: g.mentions.select("msg_id", F.col("entity_id").alias("f")).unionByName(g.keywords.select("msg_id", F.col("keyword_id").alias("f"))).distinct().groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"))
)
graph_query("set_intersect_conv", "select conv_id from ce where entity_id = (from tope) intersect select conv_id from ce where entity_id = (from tope2)")(lambda g: R.entity_timeline(g, top_entity(g), top_entity(g, 1)))
graph_query("gr_entity_timeline", "select distinct conv_id from ce where entity_id = (from tope)")(lambda g: R.entity_timeline(g, top_entity(g)))
graph_query(
    "gr_neighborhood",
    "select 'message' as kind, msg_id as id, 1::bigint as n from mentions where entity_id = (from tope) union all (select 'entity', m.entity_id, count(*) from mentions m where m.msg_id in (select msg_id from mentions where entity_id = (from tope)) and m.entity_id <> (from tope) group by 2 order by 3 desc, 2 limit 20) "
    "union all (select 'conversation', conv_id, (select count(*) from contains c where c.conv_id = ce.conv_id) from ce where entity_id = (from tope) order by 2 limit 10)",
)(lambda g: R.neighborhood(g, top_entity(g)))

# words
_TERMS = ("th", "on")
_EDGE = " + ".join(f"case when contains(lower(name), '{t}') then 1.0 + case when starts_with(lower(name), '{t}') or ends_with(lower(name), '{t}') then 0.5 else 0 end else 0 end" for t in sorted(_TERMS))
_FLAT = " + ".join(f"case when contains(lower(name), '{t}') then 1.0 else 0 end" for t in sorted(_TERMS))
_HITS = "select msg_id, ({0})::double as s from mentions join ents on id = entity_id union all select msg_id, ({1})::double from keywords join keys on id = keyword_id"
graph_query("nlp_query", f"select s.msg_id, s.score, m.role, m.conv_id from (select msg_id, round(sum(s), 4) as score from ({_HITS.format(_EDGE, _FLAT)}) where s > 0 group by 1 order by 2 desc, 1 limit 50) s join msgs m on m.id = s.msg_id")(lambda g: R.query_messages(g, " ".join(_TERMS)))
graph_query(
    "nlp_semantic",
    f"select msg_id, round(sum(s), 8) as score from ({_HITS.format(_FLAT, _FLAT)} union all select c.msg_id, 0.5 * t.weight * ({_FLAT}) from (select conv_id, entity_id, round(n / size, 6) as weight, n from ce join (select conv_id, count(*) as size from contains group by 1) using (conv_id)) t join ents on id = t.entity_id join contains c on c.conv_id = t.conv_id where t.weight >= 0.3 and t.n >= 2) where s > 0 group by 1 order by 2 desc, 1 limit 20",
)(lambda g: R.semantic_search(g, " ".join(_TERMS)))
graph_query("nlp_search_entities", f"select id, ({_EDGE})::double as score from ents where ({_EDGE}) > 0")(lambda g: g.names.where("label = 'Entity'").select("id", X.name_score(F.col("name"), sorted(_TERMS)).alias("score")).where("score > 0"))
graph_query("nlp_search_keywords", f"select id, ({_FLAT})::double as score from keys where ({_FLAT}) > 0")(lambda g: g.names.where("label = 'Keyword'").select("id", X.name_score(F.col("name"), sorted(_TERMS), False).alias("score")).where("score > 0"))
graph_query("jn_term_like", f"select id from ents where contains(lower(name), 'th')")(lambda g: g.of("Entity").where(F.lower("name").contains("th")).select("id"))

# time
graph_query("agg_bucket", "select bucket, entity_id, n from bk")(T.bucketed)
graph_query("win_topk_bucket", "select * from (select bucket, entity_id, n, row_number() over (partition by bucket order by n desc, entity_id)::int as rank from bk) where rank <= 5")(T.top_per_bucket)
graph_query("agg_overall", "select entity_id, count(*) as n from mentions group by 1 order by 2 desc, 1 limit 20")(T.overall)
graph_query("agg_bucket_activity", "select bucket, count(*) as entities, sum(n)::bigint as mentions from bk group by 1")(T.bucket_activity)
_MET = """, kb as (select count(distinct bucket) as k from bk), per as (select entity_id, min(bucket) as first, max(bucket) as last, sum(n)::bigint as total, count(*) as active_buckets, sum(n) / any_value(k) as mean, any_value(k) as k from bk, kb group by 1),
sd as (select entity_id, sqrt(sum((n - mean) * (n - mean)) / any_value(k)) as sd from bk join per using (entity_id) group by 1),
met as (select entity_id, first, last, total, active_buckets, (select count(*) from bk b where b.entity_id = per.entity_id and k > 1 and b.n > mean + 2 * sd)::bigint as bursts, case when k > 1 then round(sd / mean, 4) else 0 end as cv from per join sd using (entity_id)) """
graph_query("agg_temporal_metrics", _MET + "select * from met")(T.metrics)
graph_query("srt_bursty", _MET + "select * from met where total >= 2 and cv > 0 order by cv desc, entity_id limit 20")(T.bursty)
_TOP20 = "(select entity_id from bk group by 1 order by sum(n) desc, entity_id limit 20)"
graph_query("agg_coactivation", f"select x.entity_id as a, y.entity_id as b, count(*) as buckets, round(100 * count(*) / (select count(distinct bucket) from bk), 2) as share from bk x join bk y on x.bucket = y.bucket and x.entity_id < y.entity_id where x.entity_id in {_TOP20} and y.entity_id in {_TOP20} group by 1, 2")(T.coactivation)
ORACLES["win_bucket_share"], QUERIES["win_bucket_share"] = ORACLES["agg_coactivation"], QUERIES["agg_coactivation"]
graph_query("win_max_bar", "select entity_id, bucket, n, round(n / max(n) over (partition by entity_id), 4) as share from bk where entity_id in (select entity_id from mc order by mentions desc, entity_id limit 10)")(T.heat)
graph_query("win_first_last_bucket", "select entity_id, min(bucket) as first, max(bucket) as last from bk group by 1")(lambda g: T.metrics(g).select("entity_id", "first", "last"))
graph_query("srt_timeline_bucket", "select entity_id, sum(n)::bigint as n from bk where bucket = '1970-02' group by 1 order by 2 desc, 1 limit 20")(lambda g: T.entity_buckets(g, "1970-02"))
for _name, _days, _fmt in (("year", 365, "%Y"), ("week", 7, "%Y-W%V"), ("day", 1, "%Y-%m-%d")):
    graph_query(f"fn_bucket_{_name}", f"select strftime(make_timestamp((create_time * 1000000)::bigint), '{_fmt}') as bucket, count(*) as n from msgs group by 1")(
        lambda g, days=_days: g.of("Message").groupBy(T.bucket(F.col("create_time"), days).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )
graph_query("fn_bucket_blocks", "select 'W' || (((make_timestamp((create_time * 1000000)::bigint)::date - date '1970-01-01') + 719163) // 3) as bucket, count(*) as n from msgs group by 1")(lambda g: g.of("Message").groupBy(T.bucket(F.col("create_time"), 3).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))

# chains
_UP = ", up as (select child_id as node, parent_id as ancestor, 1 as d from replies union select up.node, r.parent_id, up.d + 1 from up join replies r on r.child_id = up.ancestor), dep as (select id, (select count(distinct ancestor) from up where node = id) as a from msgs) "
graph_query("gr_depth_ancestors", _UP + "select id, a as depth from dep")(V.ancestor_counts)
graph_query("gr_depth_longest", _UP + "select id, (a + 1)::int as depth from dep")(lambda g: V.longest_depth(g.of("Message"), g.replies))
graph_query("agg_depth_conv", _UP + ", kids as (select parent_id, count(*) as kids from replies group by 1) select conv_id, max(a + 1)::int as max_depth, round(avg(a + 1), 4) as mean_depth, count(*) as messages, round(coalesce(avg(kids), 0), 4) as branching from dep join msgs using (id) left join kids on parent_id = id group by 1")(V.depth_by_conversation)
graph_query("agg_depth_distribution", _UP + "select conv_id, string_agg((a + 1) || ':' || n, ' ' order by a) as distribution from (select conv_id, a, count(*) as n from dep join msgs using (id) group by 1, 2) group by 1")(V.depth_distribution)
graph_query("agg_depth_hist", _UP + "select (a + 1)::int as depth, count(*) as n from dep group by 1")(V.depth_histogram)
graph_query(
    "agg_conv_meta",
    _UP + ", kids as (select parent_id, count(*) as kids from replies group by 1), dom as (select conv_id, string_agg(name, ', ' order by r) as dominant_entities from (select conv_id, name, row_number() over (partition by conv_id order by n desc, entity_id) as r from ce join ents on id = entity_id) where r <= 5 group by 1) "
    "select conv_id, max(a) as max_depth, round(avg(a), 4) as mean_depth, coalesce(max(kids), 0) as branching_factor, count(*) as message_count, coalesce(any_value(dominant_entities), '') as dominant_entities from dep join msgs using (id) left join kids on parent_id = id left join dom using (conv_id) group by 1",
)(V.conversation_meta)
graph_query("gr_betweenness_msg", _UP + "select id, (a * (select count(*) from up where ancestor = id))::double as betweenness from dep")(V.message_centrality)
graph_query("gr_reply_stats", _UP + ", own as (select id, a + 1 as d from dep join msgs using (id) where conv_id = 'c1' and (id in (select child_id from replies) or id in (select parent_id from replies))) select max(d)::int as max_depth, round(avg(d), 4) as mean_depth, count(*) as messages, round((select avg(n) from (select count(*) as n from replies where parent_id in (select id from own) group by parent_id)), 4) as branching from own")(lambda g: V.reply_stats(g, "c1"))
graph_query("gr_context", ", up as (select 'm1_3' as id, 0 as hop union select r.parent_id, up.hop - 1 from up join replies r on r.child_id = up.id where up.hop > -3), down as (select 'm1_3' as id, 0 as hop union select r.child_id, down.hop + 1 from down join replies r on r.parent_id = down.id where down.hop < 3) select id, hop::int as hop from (from up union from down) where id in (select id from msgs)")(lambda g: V.context(g, "m1_3"))
graph_query("gr_conv_order", _UP + "select id as msg_id, (a + 1)::int as level, row_number() over (order by a, id)::int as place from dep join msgs using (id) where conv_id = 'c1'")(lambda g: V.conversation_order(g, "c1"))
_E2 = ", e2 as (select entity_a as a, entity_b as b from cooc where weight >= 2), both_ as (select a, b from e2 union select b, a from e2)"
graph_query("gr_components", _E2 + ", reach as (select a as x, a as y from both_ union select reach.x, both_.b from reach join both_ on both_.a = reach.y) select x as id, min(y) as component from reach group by 1")(lambda g: V.components(A.cooc_edges(g, 2).select("a", "b")))
_PATHS = _E2 + (
    ", walk as (select a as s, a as t, [a] as p, 0 as d from (select distinct a from both_) union all select w.s, x.b, list_append(w.p, x.b), w.d + 1 from walk w join both_ x on x.a = w.t where not list_contains(w.p, x.b) and w.d < 8), "
    "dist as (select s, t, min(d) as d from walk group by 1, 2), short as (select w.s, w.t, w.p from walk w join dist using (s, t) where w.d = dist.d), sig as (select s, t, count(*) as k from short group by 1, 2), "
    "bt as (select v, round(sum(n / k) / 2, 6) as betweenness from (select s, t, v, count(*) as n from (select s, t, unnest(p[2:-2]) as v from short) group by 1, 2, 3) join sig using (s, t) group by 1), "
    "all_bt as (select distinct a as v, coalesce(betweenness, 0.0) as betweenness from both_ left join bt on v = a), "
    "br as (select s as entity_a, t as entity_b, d::int as path_length, round((x.betweenness + y.betweenness) / 2, 6) as betweenness from dist join all_bt x on x.v = s join all_bt y on y.v = t where d between 2 and 4 and x.betweenness >= 0.01) "
)
graph_query("gr_betweenness_entity", _PATHS + "select v as id, betweenness, degree from all_bt join (select a, count(*) as degree from both_ group by 1) on a = v order by betweenness desc, degree desc, id limit 20")(A.entity_centrality)
graph_query("gr_shortest_bridge", _PATHS + "select entity_a, entity_b, path_length, betweenness from br")(lambda g: A.entity_bridges(g))
graph_query("gr_get_bridges", _PATHS + "select entity_a, entity_b, path_length, betweenness from br where entity_a = (select min(entity_a) from br) order by betweenness desc, entity_b limit 20")(lambda g: A.first_bridges(g).orderBy(F.desc("betweenness"), "entity_b").limit(20))
graph_query("gr_louvain")(lambda g: A.communities(g))
graph_query("gr_induced_stats")(lambda g: A.topic_clusters(g))
graph_query("gr_domains")(lambda g: A.entity_domains(g))

"""Registered reports, written as CSV and read back, and the scalar families over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.operators import algorithms as A
from threadloom.operators import reports as P
from threadloom.operators import text as X
from threadloom.operators.traversal import components
from threadloom.plans import views
from threadloom.plans.more import _DM, _VEC, _halves, _table
from threadloom.plans.queries import _E2, _EDGE, _ES, _FLAT, _HITS, _MET, _PATHS, _TERMS, _UP, graph_query, jac, table_query
from threadloom.session import durable, scratch
from threadloom.sinks import exports as K
from threadloom.sources import exports as I


def written(df: DataFrame, digits: int = 4) -> DataFrame:
    """``df`` as a CSV report, read back with its own types; texts that are null or empty come back empty."""
    path = scratch(df.sparkSession)
    K.write_report(df, path, digits)
    return I.read_csv(df.sparkSession, path, ", ".join(f"`{c}` {t}" for c, t in df.dtypes)).fillna("")


_TITLES = "titles as (select conv_id, left(arg_min(text, create_time), 60) as title from msgs where trim(text) <> '' group by 1) "
graph_query("snk_csv_centrality", _PATHS + "select v as entity_id, name, entity_type, betweenness, degree from all_bt join (select a, count(*) as degree from both_ group by 1) on a = v join ents on id = v order by betweenness desc, degree desc, v limit 20")(
    lambda g: written(P.centrality(g), 6)
)
graph_query(
    "snk_csv_depth",
    _UP + ", kids as (select parent_id, count(*) as kids from replies group by 1), hist as (select conv_id, string_agg((a + 1) || ':' || n, ' ' order by a) as d from (select conv_id, a, count(*) as n from dep join msgs using (id) group by 1, 2) group by 1), "
    + _TITLES + "select conv_id, any_value(coalesce(title, '')) as title, count(*) as messages_in_chain, max(a + 1)::int as max_depth, round(avg(a + 1), 4) as mean_depth, round(coalesce(avg(kids), 0), 4) as branching_factor, any_value(d) as depth_distribution "
    "from dep join msgs using (id) left join kids on parent_id = id join hist using (conv_id) left join titles using (conv_id) group by 1",
)(lambda g: written(P.depth(g)))
table_query(
    "snk_csv_diff",
    _DM + "select entity_id, name, n_left as left_mentions, n_right as right_mentions, abs(n_left - n_right) as difference, case when n_left > n_right then 'left' when n_left < n_right then 'right' else 'equal' end as lean from c "
    "join ents on id = entity_id order by 5 desc, 1 limit 30",
    True,
)(lambda s, d: written(P.difference(*_halves(s, d))))
graph_query("snk_csv_temporal", _MET + "select entity_id, name, total as total_mentions, first as first_bucket, last as last_bucket, active_buckets, cv, bursts as burst_buckets from met join ents on id = entity_id")(lambda g: written(P.temporal(g)))


@graph_query("snk_csv_timeline", ", best as (select entity_id from mc order by mentions desc, entity_id limit 5), every as (select distinct bucket from bk) select bucket, entity_id, coalesce(n, 0)::bigint as n from every cross join best left join bk using (bucket, entity_id)")
def _timeline(g) -> DataFrame:
    """The wide report, told apart again into a row per bucket and entity."""
    wide = written(P.timeline(g))
    return wide.unpivot("bucket", [F.col(f"`{c}`") for c in wide.columns if c != "bucket"], "entity_id", "n")


graph_query(
    "snk_csv_similarity",
    f", {_TITLES} select round(round(j, 6), 4) as jaccard, a as conv_id_a, b as conv_id_b, coalesce(x.title, '') as title_a, coalesce(y.title, '') as title_b from ({jac('conv_id', _ES)}) left join titles x on x.conv_id = a left join titles y on y.conv_id = b where round(j, 6) >= 0.05",
)(lambda g: written(P.similarity(g, 0.05)))
graph_query(
    "snk_csv_query",
    f", hit as (select msg_id, round(sum(s), 4) as score from ({_HITS.format(_EDGE, _FLAT)}) where s > 0 group by 1 order by 2 desc, 1 limit 50), "
    "en as (select msg_id, string_agg(distinct name, ', ' order by name) as entities from mentions join ents on id = entity_id group by 1), kn as (select msg_id, string_agg(distinct name, ', ' order by name) as keywords from keywords join keys on id = keyword_id group by 1) "
    "select msg_id, score, role, left(text, 300) as text, coalesce(entities, '') as entities, coalesce(keywords, '') as keywords, conv_id as conversation_id, create_time as timestamp from hit join msgs on id = msg_id left join en using (msg_id) left join kn using (msg_id)",
)(lambda g: written(P.found(g, " ".join(_TERMS))))
table_query(
    "snk_csv_embed",
    _VEC + "select b.vec_id as neighbor_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 4) as cosine_similarity, b.label from v a join v b on a.vec_id = 3 and b.vec_id <> 3 order by 2 desc, 1 limit 10",
)(lambda s, d: written(P.neighbours(_table(s, d, "embeddings"), F.col("vec_id") == 3, "vec_id", "embedding", ["label"])))
graph_query("snk_csv_topics")(lambda g: written(P.topics(g)))


@graph_query(
    "gr_louvain_quality",
    _E2 + ", reach as (select a as x, a as y from both_ union select reach.x, both_.b from reach join both_ on both_.a = reach.y), comp as (select x as id, min(y) as c from reach group by 1) "
    "select (select count(*) from comp where c in (select c from comp group by 1 having count(*) >= 3))::bigint as vertices, true as whole, true as connected, true as no_worse",
)
def _louvain_quality(g) -> DataFrame:
    """Vertices given a community; whether each community lies in one component, is connected by its own edges and bears its
    smallest id; and whether modularity is above that of the components and of single vertices."""
    comm = durable(A.communities(g))
    edges = durable(A.cooc_edges(g, 2).join(comm.select(F.col("id").alias("a")), "a", "left_semi"))
    torn = comm.groupBy("community").agg(F.count_distinct("component").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"))
    pieces = components(A.inner_edges(edges, comm).select("a", "b"), comm.select("id"))
    apart = pieces.withColumnRenamed("component", "piece").join(comm, "id").where("piece <> community").agg(F.count(F.lit(1)).alias("apart"))
    plain = A.partition_modularity(edges, components(edges.select("a", "b")).withColumnRenamed("component", "community")).select(F.col("modularity").alias("m0"))
    alone = A.partition_modularity(edges, comm.select("id", F.col("id").alias("community"))).select(F.col("modularity").alias("m1"))
    rows = A.partition_modularity(edges, comm).crossJoin(torn).crossJoin(apart).crossJoin(plain).crossJoin(alone)  # one row each
    return rows.select("vertices", (F.col("n") == 1).alias("whole"), (F.col("apart") == 0).alias("connected"), (F.col("modularity") >= F.greatest("m0", "m1")).alias("no_worse"))


# scalar families
table_query(
    "fn_string",
    r"select doc_id, left(trim(regexp_replace(trim(regexp_replace(text, '[^\p{L}\p{N}\s_-]', '', 'g')), '\s', '_', 'g'), '_'), 50) as title, "
    + "("
    + " + ".join(f"case when contains(lower(text), '{t}') then 1.0 + case when starts_with(lower(text), '{t}') or ends_with(lower(text), '{t}') then 0.5 else 0 end else 0 end" for t in ("the", "de"))
    + ")::double as score, split_part(source || '::' || lang, '::', 2) as part from documents",
)(lambda s, d: _table(s, d, "documents").select("doc_id", S.file_title(F.col("text")).alias("title"), X.name_score(F.col("text"), ["the", "de"]).alias("score"), F.split_part(F.concat_ws("::", "source", "lang"), F.lit("::"), F.lit(2)).alias("part")))
table_query("fn_regex", r"select doc_id, len(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'))::int as capitals, regexp_matches(text, '(?i)asset_pointer|file-service://|data:image/') as pointer from documents")(
    lambda s, d: _table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\p{Lu}\p{Ll}{3,}")).alias("capitals"), F.col("text").rlike(S.NOISE).alias("pointer"))
)
table_query("fn_base64", "with b as (select doc_id, base64(encode(text)) as b from documents) select doc_id, length(b) >= 100 as whole, false as cut, false as spoilt from b")(
    lambda s, d: _table(s, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\\s", "").alias("b")).select(
        "doc_id", S.is_base64(F.col("b")).alias("whole"), S.is_base64(F.substr("b", F.lit(2))).alias("cut"), S.is_base64(F.concat(F.lit("-"), F.substr("b", F.lit(2)))).alias("spoilt")
    )
)


@table_query(
    "fn_date_parse",
    "select event_id, epoch_us(ts) / 1e6 as micros, epoch_us(date_trunc('second', ts)) / 1e6 as plain, (epoch_us(ts) // 1000) / 1000 as millis, epoch_us(date_trunc('second', ts)) / 1e6 as ahead, epoch_us(date_trunc('second', ts)) / 1e6 as number, null::double as broken from events",
)
def _date_parse(s: SparkSession, d: str) -> DataFrame:
    """One instant in the forms that exports have."""
    e = _table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    at = lambda f, ahead=0: F.date_format(F.col("ts") + F.expr(f"interval {ahead} minutes"), f)
    parsed = lambda c, **o: S.parse_time(c, **o)
    return e.select(
        "event_id", parsed(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("micros"), parsed(at("yyyy-MM-dd HH:mm:ss")).alias("plain"), parsed(F.unix_millis("ts")).alias("millis"),
        parsed(F.concat(at("yyyy-MM-dd'T'HH:mm:ss", 330), F.lit("+05:30")), offsets=True).alias("ahead"), parsed(F.unix_seconds("ts").cast("string")).alias("number"),
        parsed(at("dd/MM/yyyy")).alias("broken"),
    )


table_query("fn_date_format", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso, strftime(ts, '%Y-%m-%d %H:%M:%S') as plain from events")(
    lambda s, d: _table(s, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).select("event_id", S.iso_micros(F.col("t")).alias("iso"), S.plain_time(F.col("t")).alias("plain"))
)
table_query("fn_math", "select source, round(avg(n_chars), 4) as mean, round(stddev_pop(n_chars) / avg(n_chars), 4) as cv, round(sum(1 + ln(n_chars)), 3) as logs, round(sqrt(max(n_chars)), 6) as root from documents where n_chars > 0 group by 1")(
    lambda s, d: _table(s, d, "documents").where("n_chars > 0").groupBy("source").agg(
        F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_pop("n_chars") / F.avg("n_chars"), 4).alias("cv"), F.round(F.sum(1 + F.ln("n_chars")), 3).alias("logs"), F.round(F.sqrt(F.max("n_chars")), 6).alias("root")
    )
)


@table_query(
    "fn_array_set",
    r"with t as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2) as w from conversations), "
    "p as (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as v from t) "
    "select conv_id, turn, len(list_distinct(list_intersect(w, v)))::int as shared, round(coalesce(len(list_distinct(list_intersect(w, v))) / nullif(len(list_distinct(list_concat(w, v))), 0), 0), 6) as jaccard from p where v is not null",
)
def _array_set(s: SparkSession, d: str) -> DataFrame:
    """Words that a turn shares with the one before."""
    t = _table(s, d, "conversations").select("conv_id", "turn", S.tokens(F.col("text")).alias("w"))
    p = t.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v is not null")
    return p.select("conv_id", "turn", F.size(F.array_intersect("w", "v")).alias("shared"), F.round(S.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@table_query("fn_map", "select user_id, count(*) filter (event_type = 'click') as clicks, 0::bigint as nothing, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1")
def _map(s: SparkSession, d: str) -> DataFrame:
    """Counts per user as a map, looked up with a default."""
    n = _table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("bigint"))
    return m.select("user_id", get("click").alias("clicks"), get("no such type").alias("nothing"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"))


table_query("fn_json", """select event_id, (props->>'k')::int as k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as doc from events""")(
    lambda s, d: _table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc"))
)
table_query("fn_xml", r"select doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) as h from documents")(
    lambda s, d: _table(s, d, "documents").select("doc_id", F.concat(F.lit('<a t="'), S.xml_text(F.col("text")), F.lit('"/>')).alias("x")).select("doc_id", S.sha256_hex(F.xpath_string("x", F.lit("a/@t"))).alias("h"))
)

"""Registered queries over plain tables, exports, vectors and pairs of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.operators import embedding as E
from threadloom.operators import relational as R
from threadloom.operators import temporal as T
from threadloom.operators import text as X
from threadloom.operators import traversal as V
from threadloom.plans import views
from threadloom.plans.queries import _EDGE, _FLAT, _HITS, graph_query, table_query
from threadloom.session import scratch
from threadloom.sinks import exports as K
from threadloom.sources import exports as I
from threadloom.sources import splits
from threadloom.streaming import incremental as N


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# texts of documents
def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


table_query("nlp_dedup_exact", "select min(doc_id) as doc_id from documents group by text")(lambda s, d: X.dedup_exact(_docs(s, d), "text", ("doc_id",)).select("doc_id"))
table_query("win_dedup_first", "select min(doc_id) as doc_id, source from documents group by source, text")(lambda s, d: X.dedup_exact(_docs(s, d), "text", ("doc_id",), ("source",)).select("doc_id", "source"))
_PROF = " union all ".join(f"select '{k}' as lang, unnest([{', '.join(repr(w) for w in v)}]) as w" for k, v in X.PROFILES.items())
table_query(
    "nlp_lang_detect",
    rf"with p as ({_PROF}), t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) as w from documents), "
    "c as (select doc_id, p.lang, count(*) as n from t join p using (w) group by 1, 2), b as (select doc_id, lang, n, row_number() over (partition by doc_id order by n desc, lang desc) as k from c) "
    "select d.doc_id, case when b.n >= 2 then b.lang else 'unknown' end as found from documents d left join b on b.doc_id = d.doc_id and k = 1",
)(lambda s, d: _docs(s, d).select("doc_id", X.detect_language(F.coalesce("text", F.lit("")), chars=None).alias("found")))
table_query("flt_lang", "select doc_id from documents where lang in ('en', 'es')")(lambda s, d: _docs(s, d).where(F.col("lang").isin("en", "es")).select("doc_id"))
table_query(
    "flt_noise",
    r"select doc_id, part from (select doc_id, unnest(string_split(text, chr(10))) as part from documents) where not (starts_with(part, 'data:') or (length(part) >= 100 and length(part) % 4 = 0 and regexp_matches(part, '^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$')) or regexp_matches(part, '(?i)asset_pointer|file-service://|data:image/'))",
)(lambda s, d: _docs(s, d).select("doc_id", F.explode(S.clean_parts(F.split("text", "\n", -1))).alias("part")))
table_query("fn_sha256", "select doc_id, sha256(text) as h from documents")(lambda s, d: _docs(s, d).select("doc_id", S.sha256_hex(F.col("text")).alias("h")))
table_query("fn_uuid", "select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as u from (select doc_id, md5(text) as h from documents)")(lambda s, d: _docs(s, d).select("doc_id", S.seeded_uuid(F.col("text")).alias("u")))
table_query("prj_tokens", r"select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) as n from documents")(lambda s, d: _docs(s, d).select("doc_id", F.size(S.tokens(F.col("text"))).cast("bigint").alias("n")))
_TF = (
    r"with t as (select doc_id::varchar as doc, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) as term from documents), "
    f"tf as (select doc, term, count(*) as tf from t where length(term) >= 2 and term not in ({views._words(X.STOP_WORDS)}) group by 1, 2), v as (select term, count(*) as df, sum(tf) as cf from tf group by 1 having count(*) >= 2 and count(*) <= 0.85 * (select count(*) from documents) order by cf desc, term limit 5000), "
    "i as (select term, ln((1.0 + (select count(*) from documents)) / (1 + df)) + 1 as idf from v), w as (select doc, tf.term, tf * idf as w from tf join i using (term)), q as (select term, idf as q from i where term in ('tion', 'license', 'released')), "
    "l as (select doc, sqrt(sum(w * w)) as n from w group by 1) "
)
table_query("nlp_tfidf_search", _TF + "select doc, round(dot / (n * (select sqrt(sum(q * q)) from q)), 6) as score from (select doc, sum(w * q) as dot from w join q using (term) group by 1) join l using (doc) where round(dot / (n * (select sqrt(sum(q * q)) from q)), 6) >= 0.05 order by 2 desc, 1 limit 20")(
    lambda s, d: X.tfidf_search(_docs(s, d).select(F.col("doc_id").alias("doc"), "text"), "tion released license")
)
table_query("nlp_tfidf", "select doc, term, weight from wl", True)(lambda s, d: X.tfidf(views.chat_messages(s, d).select(F.col("id").alias("doc"), "text")))

# vectors
_COS = "(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))"
_VEC = "with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings) "
table_query("emb_knn_nodes", _VEC + f"select b.vec_id, round({_COS}, 6) as cosine from v a join v b on a.vec_id = 0 and b.vec_id <> 0 order by 2 desc, 1 limit 10")(lambda s, d: E.nearest(_table(s, d, "embeddings"), 0, "vec_id", "embedding"))
table_query("emb_knn_msgs", _VEC + f"select b.vec_id, round({_COS}, 6) as cosine from v a join v b on a.vec_id = 7 and b.vec_id <> 7 where round({_COS}, 6) >= 0.1 order by 2 desc, 1 limit 25")(lambda s, d: E.nearest(_table(s, d, "embeddings"), 7, "vec_id", "embedding", 25, 0.1))
_MEAN = _VEC + ", p as (select label, unnest(e) as x, generate_subscripts(e, 1) as i from v), m as (select label, i, avg(x) as x from p group by 1, 2)"
table_query("agg_mean_vector", _MEAN + " select label, round(sqrt(sum(x * x)), 6) as length from m group by 1")(lambda s, d: E.mean_vectors(_table(s, d, "embeddings"), "label", "embedding").select("label", F.round(S.norm(F.col("embedding")), 6).alias("length")))
table_query("emb_knn_convs", _MEAN + ", c as (select label, list(x order by i) as e from m group by 1) " + f"select b.label, round({_COS}, 6) as cosine from c a join c b on a.label = (select min(label) from c) and b.label <> a.label order by 2 desc, 1 limit 10")(
    lambda s, d: E.nearest(m := E.mean_vectors(_table(s, d, "embeddings"), "label", "embedding"), m.agg(F.min("label")).first()[0], "label", "embedding")
)
table_query("fn_vector", _VEC + "select vec_id, round(sqrt(list_dot_product(e, e)), 6) as n, 1.0::double as unit from v")(lambda s, d: _table(s, d, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("n"), F.round(S.norm(S.unit(F.col("embedding"))), 6).alias("unit")))
graph_query("emb_incidence", "select msg_id as row, entity_id as col from mentions union select k.msg_id, k.keyword_id from keywords k where k.msg_id in (select msg_id from mentions)")(lambda g: E.incidence(g, True))


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    cells = _table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("row"), F.posexplode("embedding").alias("col", "value"))
    _, sigma = E.svd(cells.select("row", F.col("col").cast("string").alias("col"), "value"))
    return s.createDataFrame([(i, float(round(x, 3))) for i, x in enumerate(sigma)], "i int, sigma double")


table_query("emb_truncsvd")(_spectrum)
graph_query("emb_spectral")(lambda g: E.spectral(g).select("id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector")))


@graph_query("emb_node2vec")
def _node2vec(g) -> DataFrame:
    from threadloom.operators.algorithms import random_walks

    vectors, _ = E.svd(E.walk_pairs(random_walks(g)))
    return vectors.select("row", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@graph_query("emb_prune", "select entity_a as a, entity_b as b, weight from (select *, row_number() over (partition by v order by weight desc, entity_a, entity_b) as r from (select entity_a as v, * from cooc union all select entity_b, * from cooc)) where r <= 100 group by all")
def _prune(g) -> DataFrame:
    from threadloom.operators.algorithms import cooc_edges, prune

    return prune(cooc_edges(g, 1))


@graph_query("gr_traverse")
def _traverse(g) -> DataFrame:
    from threadloom.operators.algorithms import bridges_by_source

    near = g.cooc.select(F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), F.col("weight").cast("double").alias("score"))
    near = near.unionByName(near.select(F.col("target").alias("source"), F.col("source").alias("target"), "score"))
    start = g.cooc.orderBy(F.desc("weight"), "entity_a").first()
    return V.traverse(near, bridges_by_source(g), start["entity_a"] if start else "")


# pairs of graphs
def _halves(s: SparkSession, d: str):
    return views.chat_half(s, d, False), views.chat_half(s, d, True)


_HALF = ", la as (select distinct m.entity_id as id, x.cn % 2 as h from mentions m join msgs x on x.id = m.msg_id) "
table_query("set_diff", _HALF + "select count(*) filter (where l and not r) as left_only, count(*) filter (where r and not l) as right_only, count(*) filter (where l and r) as shared, round(count(*) filter (where l and r) / count(*), 6) as jaccard from (select id, bool_or(h = 0) as l, bool_or(h = 1) as r from la group by 1)", True)(
    lambda s, d: R.diff_counts(*_halves(s, d)).where("kind = 'Entity'").drop("kind")
)
_DM = ", c as (select m.entity_id, count(*) filter (where x.cn % 2 = 0) as n_left, count(*) filter (where x.cn % 2 = 1) as n_right from mentions m join msgs x on x.id = m.msg_id group by 1) "
table_query("jn_full_outer_diff", _DM + "select entity_id, n_left, n_right, abs(n_left - n_right) as diff, case when n_left > n_right then 'left' when n_left < n_right then 'right' else 'equal' end as lean from c order by 4 desc, 1 limit 30", True)(lambda s, d: R.diff_mentions(*_halves(s, d)))
table_query("agg_type_breakdown", _DM + "select entity_type, sum(n_left)::bigint as n_left, sum(n_right)::bigint as n_right from c join ents on id = entity_id group by 1", True)(lambda s, d: R.diff_types(*_halves(s, d)))
_BATCH = "({0}select id, label from nodes)"
table_query(
    "set_merge_batches",
    f"with b as ({_BATCH.format(views.chat_sql(chr(39) + 'c' + chr(39) + ' || conv_id < ' + chr(39) + 'c5' + chr(39)))} union {_BATCH.format(views.chat_sql(chr(39) + 'c' + chr(39) + ' || conv_id >= ' + chr(39) + 'c5' + chr(39)))}) select label, count(*) as n from b group by 1",
)(  # keywords are those of each batch's own TF-IDF
    lambda s, d: N.extend(*N.extend(_empty(s), s.createDataFrame([], "id string"), (m := views.chat_messages(s, d)).where("conversation_id < 'c5'")), m)[0].nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
)


def _empty(s: SparkSession):
    from threadloom.graph import Graph

    return Graph.empty(s)


table_query("jn_unprocessed", "select id from msgs where cn % 3 <> 0", True)(lambda s, d: N.unprocessed(views.chat_messages(s, d), _third(s, d)).select("id"))
table_query("jn_new_messages", "select id from msgs where cn % 3 <> 0 order by id limit 20 offset 10", True)(lambda s, d: N.page(N.unprocessed(views.chat_messages(s, d), _third(s, d)).withColumn("seq", F.col("id")), 10, 20).select("id"))


def _third(s: SparkSession, d: str) -> DataFrame:
    return views.chat_messages(s, d).where(F.substring("conversation_id", 2, 20).cast("bigint") % 3 == 0).select("id")


table_query("flt_offset_limit", "select doc_id from documents order by doc_id limit 50 offset 100")(lambda s, d: _docs(s, d).select("doc_id").orderBy("doc_id").offset(100).limit(50))
graph_query("flt_orphan_parent", "select id, parent from msgs where parent in (select id from msgs)")(lambda g: g.replies.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent")))
table_query("gr_backfill", "select id, case when cn % 3 = 0 then 5.0 else create_time end::double as create_time from msgs", True)(lambda s, d: R.backfill_times(g := views.chat_untimed(s, d), g.of("Message").select("id", F.lit(5.0).alias("create_time"))).where("label = 'Message'").select("id", "create_time"))
table_query("win_pseudo_time", "select id, ((row_number() over (order by id) - 1) * 86400)::double as create_time from msgs", True)(lambda s, d: T.pseudo_times(views.chat_messages(s, d).select("id")))

# exports: provider documents made from the table, parsed back
def _convs(s: SparkSession, d: str) -> DataFrame:
    t = _table(s, d, "conversations")
    m = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = t.groupBy(F.concat(F.lit("c"), "conv_id").alias("id")).agg(m.alias("ms"))
    msg = lambda x: F.struct(x["role"].alias("role"), F.trim(x["text"]).alias("content"), F.lit(1.7e9).alias("created_at"), F.lit("m").alias("model"))
    return I._shape(rows, id=F.col("id"), title=F.concat(F.lit("Title "), "id"), messages=F.transform("ms", msg), created_at=F.lit(1.7e9), updated_at=F.lit(1.7e9), source_format=F.lit("table"))


#: Parsers know the assistant; every other role is the user.
_BACK = "select 'c' || conv_id as id, count(*)::int as n, sha256(string_agg(case when role = 'assistant' then role else 'user' end || ':' || trim(text), chr(10) order by turn)) as h from conversations group by 1"


def _digest(convs: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return convs.select("id", F.size("messages").alias("n"), S.sha256_hex(said).alias("h"))


#: Bytes of a range where the tables' exports are read back, so that their lists are cut into many.
CUT = 1 << 15


def _lists(s: SparkSession, docs: DataFrame) -> str:
    path = scratch(s)
    K.write_lists(docs, path)
    return path


def _parsed(s: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents written as lists, one a file, and read back by byte ranges."""
    return splits.parse_exports(s, _lists(s, docs), pattern="part-*", size=CUT)


table_query("src_openai", _BACK)(lambda s, d: _digest(_parsed(s, K.to_openai(_convs(s, d)).select("doc"))))
table_query("src_anthropic", _BACK)(lambda s, d: _digest(_parsed(s, K.to_anthropic(_convs(s, d)).select("doc"))))


def _gemini_file(s: SparkSession, d: str) -> DataFrame:
    docs = K.to_gemini(_convs(s, d)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "doc"))).alias("ds"))
    return docs.select(F.lit("x.json").alias("path"), F.concat(F.lit("["), F.array_join(F.transform("ds", lambda x: x["doc"]), ","), F.lit("]")).alias("raw"))


table_query("src_message_array", _BACK)(
    lambda s, d: _digest(_parsed(s, K.to_gemini(_convs(s, d)).repartition("id").sortWithinPartitions("id", "place").select("doc")))
)


def _markdown(s: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.transform("messages", lambda m: F.concat(F.when(m["role"] == "assistant", "#### ChatGPT:\n").otherwise("#### You:\n"), m["content"], F.lit("\n"))), "")
    return _convs(s, d).select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "title", F.lit("\n"), body).alias("raw"))


table_query("src_markdown", _BACK.replace("select 'c' || conv_id as id,", "select 'Title c' || conv_id as title,"))(lambda s, d: _digest(I.parse(_markdown(s, d)).withColumn("id", F.col("title"))).withColumnRenamed("id", "title"))
table_query("src_parse_dispatch", "select 3::bigint * count(distinct conv_id) as n from conversations")(
    lambda s, d: I.parse(
        K.to_openai(_convs(s, d)).unionByName(K.to_anthropic(_convs(s, d))).select(F.lit("x.json").alias("path"), F.col("doc").alias("raw")).unionByName(_markdown(s, d)).unionByName(s.createDataFrame([("y.json", "{broken")], "path string, raw string"))
    ).agg(F.count(F.lit(1)).alias("n"))
)
table_query("src_detect_format", "select f, n from (values ('openai_individual'), ('anthropic_individual'), ('gemini'), ('openai_md')) t(f), (select count(distinct conv_id) as n from conversations)")(
    lambda s, d: K.to_openai(_convs(s, d)).unionByName(K.to_anthropic(_convs(s, d))).select(F.lit("x.json").alias("path"), F.col("doc").alias("raw")).unionByName(_gemini_file(s, d)).unionByName(_markdown(s, d))
    .groupBy(I.detect_format(F.col("raw"), F.col("path")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
)
table_query("src_json_array", "select 'c' || conv_id as conversation_id, count(*) as n, sum(length(trim(text)))::bigint as chars from conversations group by 1")(
    lambda s, d: I.extract(splits.read_elements(s, _lists(s, K.to_openai(_convs(s, d)).select("doc")), pattern="part-*", size=CUT))
    .groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
)
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_AT = lambda *paths: [F.get_json_object("doc", p) for p in paths]
table_query("snk_openai", f"select id, 'Title ' || id as title, {_UUID} as current_node, 1.7e9 as create_time, n from (select 'c' || conv_id as id, count(*)::int + 1 as n, md5('c' || conv_id || '_' || (count(*) - 1)) as h from conversations group by conv_id)")(
    lambda s, d: K.to_openai(_convs(s, d)).select("id", *[c.alias(k) for c, k in zip(_AT("$.title", "$.current_node"), ("title", "current_node"))], F.get_json_object("doc", "$.create_time").cast("double").alias("create_time"), F.size(F.json_object_keys(F.get_json_object("doc", "$.mapping"))).alias("n"))
)
table_query(
    "snk_anthropic",
    f"select id, 'Title ' || id as name, case when role = 'user' then 'human' else role end as sender, {_UUID} as uuid, '2023-11-14T22:13:20.000000Z' as created_at, text from (select 'c' || conv_id as id, arg_min(role, turn) as role, md5('c' || conv_id || '_0') as h, trim(arg_min(text, turn)) as text from conversations group by conv_id)",
)(
    lambda s, d: K.to_anthropic(_convs(s, d)).select("id", *[c.alias(k) for c, k in zip(_AT("$.name", "$.chat_messages[0].sender", "$.chat_messages[0].uuid", "$.created_at", "$.chat_messages[0].content[0].text"), ("name", "sender", "uuid", "created_at", "text"))])
)
table_query(
    "snk_gemini",
    "select 'c' || conv_id as group_id, place::int as place, 'r_' || left(md5('c' || conv_id || '_' || place), 16) || '_' || r as id, '2023-11-14 22:13:20' as created_at, t as text from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as place, case when role = 'assistant' then role else 'user' end as r, trim(text) as t from conversations)",
)(lambda s, d: K.to_gemini(_convs(s, d)).select("place", *[c.alias(k) for c, k in zip(_AT("$.chatGroupId", "$.id", "$.created_at", "$.contents[0].content"), ("group_id", "id", "created_at", "text"))]))
table_query("win_prev_chain", "select 'c' || conv_id as id, count(*)::int + 1 as nodes from conversations group by 1")(lambda s, d: K.to_openai(_convs(s, d)).select("id", F.size(F.json_object_keys(F.get_json_object("doc", "$.mapping"))).alias("nodes")))
_LINKS = (("CONTAINS", "conv_id", "msg_id", "contains", "1"), ("REPLIES_TO", "parent_id", "child_id", "replies", "1"), ("MENTIONS", "msg_id", "entity_id", "mentions", "1"), ("CO_OCCURS_WITH", "entity_a", "entity_b", "cooc", "weight"), ("CO_OCCURS_WITH", "entity_b", "entity_a", "cooc", "weight"), ("HAS_KEYWORD", "msg_id", "keyword_id", "keywords", "weight"))


@graph_query(
    "snk_gexf",
    "select label as kind, id as a, coalesce(nullif(name, ''), nullif(left(text, 80), ''), id) as b, null::double as w from nodes union all " + " union all ".join(f"select '{k}', {a}, {b}, {w}::double from {t}" for k, a, b, t, w in _LINKS),
)
def _gexf(g) -> DataFrame:
    """Nodes and edges of the lines, read as XML."""
    at = lambda p, k: F.xpath_string("line", F.lit(p)).alias(k)
    lines = K.gexf(g)
    nodes = lines.where("part = 3").select(at("node/attvalues/attvalue[@for='label']/@value", "kind"), at("node/@id", "a"), at("node/@label", "b"), F.lit(None).cast("double").alias("w"))
    return nodes.unionByName(lines.where("part = 5").select(at("edge/@kind", "kind"), at("edge/@source", "a"), at("edge/@target", "b"), F.xpath_double("line", F.lit("edge/@weight")).alias("w")))


graph_query("snk_graph_dict", "select id, label, nullif(name, '') as name from nodes")(lambda g: K.graph_dict(g).select("id", F.get_json_object("attrs", "$.label").alias("label"), F.get_json_object("attrs", "$.name").alias("name")))
graph_query("snk_console", "select role, count(*) as n, repeat('#', round(count(*) * 40 / (select max(n) from (select count(*) as n from msgs group by role)))::int) as bar from msgs group by 1")(lambda g: K.bars(g.of("Message").groupBy("role").agg(F.count(F.lit(1)).alias("n")), "n"))
graph_query(
    "nlp_llm_context",
    f", hit as (select msg_id, round(sum(s), 4) as score from ({_HITS.format(_EDGE, _FLAT)}) where s > 0 group by 1 order by 2 desc, 1 limit 50), line as (select conv_id, msg_id, score, '[' || role || '] ' || left(text, 500) || chr(10) as line from hit join msgs on id = msg_id), "
    "used as (select *, sum(length(line)) over (order by score desc, msg_id rows unbounded preceding) as used from line) select conv_id, string_agg(line, '' order by score desc, msg_id) as context from used where used <= 5000 group by 1",
)(lambda g: R.llm_context(R.with_message(g, R.query_messages(g, "th on").select("msg_id", "score")), 5000))
table_query("gr_ontology", "select edge, source, target from (values ('CONTAINS', 'Conversation', 'Message'), ('REPLIES_TO', 'Message', 'Message'), ('MENTIONS', 'Message', 'Entity'), ('CO_OCCURS_WITH', 'Entity', 'Entity'), ('HAS_KEYWORD', 'Message', 'Keyword'), ('HAS_TOPIC', 'Conversation', 'Entity'), ('SIMILAR_TO', 'Message', 'Message'), ('BRIDGES', 'Entity', 'Entity')) t(edge, source, target)")(
    lambda s, d: _ontology(s).select("edge", "source", "target")
)


def _ontology(s: SparkSession) -> DataFrame:
    from threadloom.ontology import edges

    return edges(s)


# larger tables
graph_sql = (
    "with ent as (select distinct 'o' || l_orderkey as msg_id, 'entity::' || p_brand || '::' || p_name || '_' || p_partkey as entity_id from lineitem join part on p_partkey = l_partkey), "
)
table_query("basket_top_entities", graph_sql + "n as (select entity_id as id, count(*) as mention_count from ent group by 1) select id, p_name as name, p_brand as entity_type, mention_count from n join part on id = 'entity::' || p_brand || '::' || p_name || '_' || p_partkey order by 4 desc, 1 limit 20")(lambda s, d: R.top_entities(views.basket(s, d)))
table_query("basket_cooccurrence", graph_sql + "p as (select a.entity_id as entity_a, b.entity_id as entity_b, count(*) as weight from ent a join ent b on a.msg_id = b.msg_id and a.entity_id < b.entity_id group by 1, 2) select * from p where weight >= 2")(lambda s, d: views.basket(s, d).cooc.where("weight >= 2"))
table_query("basket_activity", graph_sql + "b as (select strftime(o_orderdate, '%Y-%m') as bucket, entity_id, count(*) as n from ent join orders on msg_id = 'o' || o_orderkey group by 1, 2) select bucket, count(*) as entities, sum(n)::bigint as mentions from b group by 1")(lambda s, d: T.bucket_activity(views.basket(s, d)))
table_query("basket_topics", graph_sql + "c as (select 'u' || o_custkey as conv_id, entity_id, count(*) as n from ent join orders on msg_id = 'o' || o_orderkey group by 1, 2), z as (select 'u' || o_custkey as conv_id, count(*) as size from orders group by 1) select conv_id, entity_id, round(n / size, 6) as weight from c join z using (conv_id) where round(n / size, 6) >= 0.1 and n >= 2")(lambda s, d: R.conversation_topics(views.basket(s, d), 0.1))
table_query("basket_keyword_stats", "with k as (select 'o' || l_orderkey as msg_id, 'keyword::' || p_type as keyword_id, sum(l_quantity) as weight from lineitem join part on p_partkey = l_partkey group by 1, 2) select keyword_id, count(*) as n, round(sum(weight), 7) as total, round(avg(weight), 7) as avg_weight from k group by 1")(lambda s, d: R.keyword_stats(views.basket(s, d)))
table_query("stream_windowed_counts", "select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by 1, 2")(lambda s, d: N.windowed_counts(_table(s, d, "events")))

"""Registered queries over what was written and read back, over derived tables, and small views of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.graph import Graph, known_terms, mentions_of
from threadloom.operators import algorithms as A
from threadloom.operators import embedding as E
from threadloom.operators import relational as R
from threadloom.operators import text as X
from threadloom.operators import traversal as V
from threadloom.plans import views
from threadloom.plans.more import CUT, _convs, _halves, _table
from threadloom.plans.queries import _FS, _PATHS, graph_query, jac, table_query
from threadloom.session import scratch
from threadloom.sinks import exports as K
from threadloom.sources import exports as I
from threadloom.sources import splits


def stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_graph(g: Graph) -> Graph:
    path = scratch(g.spark)
    g.write(path)
    return Graph.read(g.spark, path)


_MSGS = "select id, role, text, parent from msgs"
graph_query("snk_graph", "select label, count(*) as n from nodes group by 1")(lambda g: R.nodes_by_label(stored_graph(g)))
graph_query("src_graph_db", "select entity_a, entity_b, weight from cooc")(lambda g: stored_graph(g).cooc)
table_query("snk_messages", _MSGS, True)(lambda s, d: stored(views.chat_messages(s, d)).select("id", "role", "text", "parent"))
table_query("src_messages_table", _MSGS, True)(lambda s, d: stored(views.chat_messages(s, d)).select("id", "role", "text", "parent"))


@graph_query("src_from_pickle", "select id, label, role, text, name, entity_type, nullif(create_time, 0) as create_time from nodes")
def _from_dicts(g: Graph) -> DataFrame:
    """Nodes as attribute dictionaries on disk, one a line, and back; empty and zero values are left out of a dictionary."""
    path = scratch(g.spark)
    K.graph_dict(g).select(F.to_json(F.struct("id", "attrs")).alias("value")).write.text(path)
    lines = g.spark.read.text(path).select(F.from_json("value", "id string, attrs string").alias("x"))
    return I.nodes_of_dicts(lines.select("x.id", "x.attrs"))



@graph_query("snk_reset", "select 'before' as moment, (select count(*) from nodes) as nodes, (select count(*) from mentions) as mentions union all select 'after', 0, 0")
def _reset(g: Graph) -> DataFrame:
    """A filled store, and the same store after a reset."""
    path = scratch(g.spark)
    g.write(path)

    def seen(moment: str) -> DataFrame:
        now = Graph.read(g.spark, path)
        n = now.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(now.mentions.agg(F.count(F.lit(1)).alias("mentions")))
        return stored(n.select(F.lit(moment).alias("moment"), "nodes", "mentions"))

    before = seen("before")
    Graph.empty(g.spark).write(path)
    return before.unionByName(seen("after"))


_CELLS = "select {0} as id, len(embedding)::int as dim, list_sum(list_transform(embedding, lambda x: floor(256 * x::double)::bigint))::bigint as total from embeddings"


def _cells(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Length and sum of the integer components of each vector."""
    total = F.aggregate(vector, F.lit(0).cast("bigint"), lambda s, x: s + F.floor(256 * x.cast("double")))
    return df.select(F.col(key).alias("id"), F.size(vector).alias("dim"), total.alias("total"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "embeddings")


table_query("snk_embeddings", _CELLS.format("vec_id"))(lambda s, d: _cells(stored(_vectors(s, d).select("vec_id", "embedding")), "vec_id", "embedding"))


@table_query("src_embeddings", "select vec_id::varchar as id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm from embeddings")
def _load_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors read with the declared schema, whatever else the store holds."""
    path = scratch(s)
    _vectors(s, d).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), "label").write.parquet(path)
    back = s.read.schema("id string, vector array<float>").parquet(path)
    return back.select("id", F.round(S.norm(F.col("vector")), 4).alias("norm"))


@table_query("emb_store_load", "select count(*) as n, count(*) as same from embeddings")
def _store_load(s: SparkSession, d: str) -> DataFrame:
    """How many vectors come back from the store, and how many of them unchanged."""
    old = _vectors(s, d).select("vec_id", "embedding")
    new = stored(old).select("vec_id", F.col("embedding").alias("back"))
    return old.join(new, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding") == F.col("back")).alias("same"))


@table_query("snk_npz", _CELLS.format("vec_id::varchar"))
def _npz(s: SparkSession, d: str) -> DataFrame:
    """Compressed blocks, stored and read back."""
    return _cells(I.npz_rows(stored(K.to_npz(_vectors(s, d), "vec_id", "embedding"))), "id", "vector")


_BULK = {
    "Conversation": ("id", "name"), "Message": ("id", "text"), "Entity": ("id", "name"), "Keyword": ("id", "name"), "contains": ("conv_id", "msg_id"), "replies": ("parent_id", "child_id"),
    "mentions": ("msg_id", "entity_id"), "cooc": ("entity_a", "entity_b"), "keywords": ("msg_id", "keyword_id"),
}


@graph_query("snk_kuzu", " union all ".join(f"select '{t}' as part, {a} as a, {b} as b from {t}" if t[0].islower() else f"select '{t}', {a}, {b} from nodes where label = '{t}'" for t, (a, b) in reversed(_BULK.items())))
def _bulk(g: Graph) -> DataFrame:
    """All nine tables of the bulk load, read back."""
    path = scratch(g.spark)
    K.write_bulk(g, path)
    out = None
    for t, (a, b) in _BULK.items():
        schema = g.of(t).drop("label").schema if t[0].isupper() else getattr(g, t).schema
        rows = I.read_csv(g.spark, f"{path}/{'nodes' if t[0].isupper() else 'edges'}/{t}", schema).select(F.lit(t).alias("part"), F.col(a).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out


graph_query("jn_kuzu_match", "select msg_id, entity_id from mentions join (select distinct id from nodes) a on a.id = msg_id join (select distinct id from nodes) b on b.id = entity_id")(
    lambda g: g.mentions.join(g.nodes.select(F.col("id").alias("msg_id")), "msg_id", "left_semi").join(g.nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("msg_id", "entity_id")
)


def _files(s: SparkSession, d: str) -> str:
    """Text files of one document a line, in a folder and in one below it."""
    path = scratch(s)
    docs = K.to_openai(_convs(s, d)).select("doc")
    K.write_lists(docs, path)
    K.write_lists(docs, f"{path}/deeper")
    return path


def _read_back(s: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    found = splits.read_elements(s, paths, recursive, "part-*", size=CUT)
    return I.extract(found).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


_PER = "select 'c' || conv_id as conversation_id, count(*) as n from conversations group by 1"
table_query("src_json_file", _PER)(lambda s, d: _read_back(s, f"{_files(s, d)}/part-*"))
table_query("src_json_dir", _PER)(lambda s, d: _read_back(s, _files(s, d)))
table_query("src_recursive_walk", _PER.replace("count(*)", "2 * count(*)"))(lambda s, d: _read_back(s, _files(s, d), True))


def _zipped(s: SparkSession, d: str) -> DataFrame:
    """One archive per conversation, beside a broken one."""
    archives = K.to_zips(K.to_openai(_convs(s, d)).select(F.concat("id", F.lit(".json")).alias("name"), F.col("doc").alias("raw")))
    broken = s.createDataFrame([("broken.zip", bytearray(b"PK"))], "path string, content binary")
    return I.extract(I.zip_members(archives.unionByName(broken))).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


table_query("src_json_zip", _PER)(_zipped)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return K.to_openai(_convs(s, d)).select(F.lit("x.json").alias("path"), F.col("doc").alias("raw"))


_TURNS = "select 'c' || conv_id as conversation_id, role, trim(text) as text from conversations"
table_query("prj_message", _TURNS)(lambda s, d: I.extract(_docs(s, d)).select("conversation_id", "role", "text"))


@table_query("flt_content_text", _TURNS + " where role <> 'user'")
def _text_only(s: SparkSession, d: str) -> DataFrame:
    """Exports whose user turns are code: those are no text."""
    turned = F.regexp_replace("raw", r'("author":\{"role":"user"\},"create_time":[^,]*,"content":\{"content_type":)"text"', '$1"code"')
    return I.extract(_docs(s, d).withColumn("raw", turned)).select("conversation_id", "role", "text")


table_query("set_concat_sources", _PER.replace("count(*)", "2 * count(*)"))(lambda s, d: I.extract(_docs(s, d).unionByName(_docs(s, d))).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")))


def _split(s: SparkSession, d: str) -> DataFrame:
    """Folders by title as they stand on disk, and how many documents each holds."""
    path = scratch(s)
    K.write_split(_convs(s, d), path)
    return s.read.text(path).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


table_query("snk_split", "select 'Title_c' || conv_id || '_' || left(md5('c' || conv_id), 8) as file_name, 1::bigint as n from conversations group by conv_id")(_split)


@table_query("src_lang_config", "select lang, count(*) as n, lang in ('de', 'en', 'es', 'fr') as configured from documents group by 1")
def _languages(s: SparkSession, d: str) -> DataFrame:
    """Languages of the corpus and whether a profile is configured for them."""
    known = s.createDataFrame([(k,) for k in X.PROFILES], "lang string").withColumn("known", F.lit(True))
    n = _table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(known), "lang", "left").select("lang", "n", F.coalesce("known", F.lit(False)).alias("configured"))  # a row per profile


table_query(
    "flt_entity_type",
    r"select distinct 'm' || conv_id || '_' || turn as msg_id, 'entity::ORG::' || lower(w) as entity_id from (select conv_id, turn, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) as w from conversations) where w = 'The'",
)(lambda s, d: mentions_of(views.chat_messages(s, d), known_terms({"The": "ORG", "the": "DATE", "of": "MONEY"})).select("msg_id", "entity_id"))
table_query("flt_has_ts", "select id from msgs where cn % 3 <> 0", True)(lambda s, d: views.chat_untimed(s, d).of("Message").where("create_time is not null").select("id"))
graph_query("jn_parent_known", "select parent_id, child_id from replies")(lambda g: g.replies)
graph_query("jn_mention_ts_inner", "select entity_id, create_time from mt where create_time is not null")(
    lambda g: g.mentions.join(g.of("Message").where("create_time is not null").select(F.col("id").alias("msg_id"), "create_time"), "msg_id").select("entity_id", "create_time")
)
graph_query("jn_cooc_decode", "select a.name as a, b.name as b, weight from cooc join ents a on a.id = entity_a join ents b on b.id = entity_b")(
    lambda g: g.cooc.join(g.names.select(F.col("id").alias("entity_a"), F.col("name").alias("a")), "entity_a").join(g.names.select(F.col("id").alias("entity_b"), F.col("name").alias("b")), "entity_b").select("a", "b", "weight")
)
graph_query("jn_multihop", "select distinct m.msg_id from mentions m join contains using (msg_id) where conv_id in (select conv_id from ce where entity_id = (select entity_id from tope))")(
    lambda g: g.mentions.join(g.contains, "msg_id").join(R.entity_timeline(g, _first(g)), "conv_id", "left_semi").select("msg_id").distinct()
)


def _first(g: Graph) -> str:
    from threadloom.plans.queries import top_entity

    return top_entity(g)


graph_query("srt_children", "select parent_id, child_id, row_number() over (partition by parent_id order by create_time, child_id)::int as place from replies join msgs on id = child_id")(
    lambda g: g.replies.join(g.of("Message").select(F.col("id").alias("child_id"), "create_time"), "child_id").select(
        "parent_id", "child_id", F.row_number().over(Window.partitionBy("parent_id").orderBy("create_time", "child_id")).alias("place")
    )
)
graph_query("srt_topk", "select entity_a, entity_b, weight from cooc order by weight desc, entity_a, entity_b limit 10")(lambda g: g.cooc.orderBy(F.desc("weight"), "entity_a", "entity_b").limit(10))
graph_query("snk_semantics", "select id, coalesce(mentions, 0) as mention_count from ents left join mc on id = entity_id")(lambda g: stored(R.entity_enrichment(g)))
@graph_query(
    "gr_enrich_all",
    "select 'Entity' as label, id, coalesce(mentions, 0)::double as value from ents left join mc on id = entity_id union all select 'Keyword', keyword_id, round(avg(weight), 7) from keywords group by 2 "
    "union all select 'Conversation', conv_id, count(*) from contains group by 2",
)
def _enriched(g: Graph) -> DataFrame:
    """One measure of every enriched node."""
    row = lambda df, label, key, value: df.select(F.lit(label).alias("label"), F.col(key).alias("id"), F.col(value).cast("double").alias("value"))
    both = row(R.entity_enrichment(g), "Entity", "id", "mention_count").unionByName(row(R.keyword_enrichment(g), "Keyword", "id", "avg_tfidf"))
    return both.unionByName(row(V.conversation_meta(g), "Conversation", "conv_id", "message_count"))


graph_query(
    "gr_derive_all",
    _PATHS + "select 'HAS_TOPIC' as edge, (select count(*) from ce join (select conv_id, count(*) as size from contains group by 1) using (conv_id) where round(n / size, 6) >= 0.3 and n >= 2) as n "
    f"union all select 'SIMILAR_TO', (select count(*) from ({jac('msg_id', _FS)}) where j >= 0.3) union all select 'BRIDGES', (select count(*) from br)",
)(
    lambda g: R.conversation_topics(g).agg(F.count(F.lit(1)).alias("n")).select(F.lit("HAS_TOPIC").alias("edge"), "n")
    .unionByName(R.cross_links(g).agg(F.count(F.lit(1)).alias("n")).select(F.lit("SIMILAR_TO").alias("edge"), "n"))
    .unionByName(A.count_bridges(g).select(F.lit("BRIDGES").alias("edge"), "n"))
)
def _parts(s: SparkSession, d: str) -> tuple[Graph, Graph]:
    """Two graphs that share every third conversation and together hold all."""
    return views.chat_part(s, d, 0), views.chat_part(s, d, 1)


def _nodes_of(where: str) -> str:
    return "(" + views.chat_sql(where) + "select id, label, name from nodes)"


_DIFF = (
    f"with l as {_nodes_of('conv_id % 3 <> 0')}, r as {_nodes_of('conv_id % 3 <> 1')}, "
    "d as (select coalesce(l.label, r.label) as kind, count(*) filter (r.id is null) as left_only, count(*) filter (l.id is null) as right_only, count(*) filter (l.id is not null and r.id is not null) as shared "
    "from l full join r on l.id = r.id group by 1) "
)
for _name, _cols in (("gr_diff", ("kind", "left_only", "right_only", "shared", "jaccard")), ("agg_diff_summary", ("kind", "left_only", "right_only", "shared")), ("set_jaccard_graph", ("kind", "jaccard"))):
    table_query(_name, _DIFF + f"select {', '.join(_cols).replace('jaccard', 'round(shared / (left_only + right_only + shared), 6) as jaccard')} from d where kind <> 'Message'")(
        lambda s, d, cols=_cols: R.diff_counts(*_parts(s, d)).select(*cols)
    )
graph_query("agg_type_dist")(
    lambda g: A.communities(g).join(g.names.select("id", "entity_type"), "id").groupBy("community", "entity_type").agg(F.count(F.lit(1)).alias("n"))
)
graph_query("agg_cluster_keywords")(lambda g: A.topic_clusters(g).select("community", "keywords"))


@graph_query("emb_variance")
def _variance(g: Graph) -> DataFrame:
    cells = E.incidence(g)
    _, sigma = E.svd(cells)
    return g.spark.createDataFrame([(round(E.explained_variance(sigma, cells), 4),)], "share double")


graph_query("emb_run")(lambda g: E.spectral(g, 32, True).select("id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector")))

"""Writers: provider formats as JSON columns, graph exchange text, tables and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import file_title, iso_micros, plain_time, seeded_uuid, xml_text
from threadloom.graph import Graph
from threadloom.sources.exports import CSV


def _indexed(i: Column) -> Column:
    return seeded_uuid(F.concat("id", F.lit("_"), i.cast("string")))


def to_anthropic(convs: DataFrame) -> DataFrame:
    """(id, doc): one JSON document per conversation."""

    def message(m: Column, i: Column) -> Column:
        at = iso_micros(m["created_at"])
        block = F.struct(F.lit("text").alias("type"), m["content"].alias("text"))
        return F.struct(
            _indexed(i).alias("uuid"), m["content"].alias("text"), F.array(block).alias("content"),
            F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), at.alias("created_at"), at.alias("updated_at"),
            F.array().cast("array<string>").alias("attachments"), F.array().cast("array<string>").alias("files"),
        )

    doc = F.struct(
        F.col("id").alias("uuid"), F.col("title").alias("name"), F.lit("").alias("summary"), iso_micros(F.col("created_at")).alias("created_at"),
        iso_micros(F.coalesce("updated_at", "created_at")).alias("updated_at"),
        F.struct(F.lit("00000000-0000-0000-0000-000000000000").alias("uuid")).alias("account"), F.transform("messages", message).alias("chat_messages"),
    )
    return convs.select("id", F.to_json(doc).alias("doc"))


def to_openai(convs: DataFrame, now: float = 0.0) -> DataFrame:
    """(id, doc): a linear mapping below a synthetic root; messages without a time get ``now``."""
    root = seeded_uuid(F.concat("id", F.lit("_root")))
    last = F.size("messages") - 1

    def node(m: Column, i: Column) -> Column:
        msg = F.struct(
            _indexed(i).alias("id"), F.struct(m["role"].alias("role")).alias("author"), F.coalesce(m["created_at"], F.lit(now)).alias("create_time"),
            F.struct(F.lit("text").alias("content_type"), F.array(m["content"]).alias("parts")).alias("content"),
            F.lit("finished_successfully").alias("status"), F.lit(1.0).alias("weight"),
            F.struct(F.coalesce(m["model"], F.lit("auto")).alias("model_slug")).alias("metadata"), F.lit("all").alias("recipient"),
        )
        kids = F.when(i < last, F.array(_indexed(i + 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(_indexed(i).alias("key"), F.struct(_indexed(i).alias("id"), msg.alias("message"), F.when(i == 0, root).otherwise(_indexed(i - 1)).alias("parent"), kids.alias("children")).alias("value"))

    nodes = F.transform("messages", node)
    none = F.get(nodes, F.lit(-1))["value"]["message"]
    kids = F.when(last >= 0, F.array(_indexed(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    top = F.struct(root.alias("key"), F.struct(root.alias("id"), none.alias("message"), F.lit(None).cast("string").alias("parent"), kids.alias("children")).alias("value"))
    doc = F.struct(
        F.col("id").alias("conversation_id"), F.col("id"), "title", F.coalesce("created_at", F.lit(now)).alias("create_time"),
        F.coalesce("updated_at", "created_at", F.lit(now)).alias("update_time"), F.when(last >= 0, _indexed(last)).otherwise(root).alias("current_node"),
        F.lit("auto").alias("default_model_slug"), F.map_from_entries(F.concat(F.array(top), nodes)).alias("mapping"),
    )
    return convs.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def to_gemini(convs: DataFrame, now: float = 0.0) -> DataFrame:
    """(id, place, doc): one JSON document per message."""
    rows = convs.select("id", F.posexplode("messages").alias("place", "m"))
    role = F.when(F.col("m.role") == "assistant", "assistant").otherwise("user")
    at = F.coalesce("m.created_at", F.lit(now))
    short = F.substring(F.md5(F.concat("id", F.lit("_"), F.col("place").cast("string")).cast("binary")), 1, 16)
    doc = F.struct(
        F.concat(F.lit("r_"), short, F.lit("_"), role).alias("id"), F.col("id").alias("chatGroupId"), role.alias("role"), F.lit("gemini").alias("model"),
        F.lit("Gemini").alias("displayModel"), F.array(F.struct(F.lit("text").alias("type"), F.col("m.content").alias("content"))).alias("contents"),
        plain_time(at).alias("created_at"), (at * 1000).cast("bigint").alias("updated_at"),
    )
    return rows.select("id", "place", F.to_json(doc).alias("doc"))


WRITERS = {"anthropic": to_anthropic, "openai": to_openai, "gemini": to_gemini}


def write_split(convs: DataFrame, path: str, form: str = "openai") -> DataFrame:
    """One folder per conversation, named by its title; returns (id, file_name)."""
    name = F.coalesce(F.nullif(file_title(F.col("title")), F.lit("")), F.lit("untitled"))
    named = convs.select("id", F.concat(name, F.lit("_"), F.substring(F.md5("id"), 1, 8)).alias("file_name"))
    docs = WRITERS[form](convs).join(named, "id")
    docs.select("file_name", F.col("doc").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)
    return named


def to_zips(files: DataFrame) -> DataFrame:
    """(path, content): one archive per file of (name, raw); a null raw is an empty member."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            contents = []
            for name, raw in zip(f["name"], f["raw"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, raw or "")
                contents.append(held.getvalue())
            yield pd.DataFrame({"path": f["name"].str.replace(r"\.[^.]*$", "", regex=True) + ".zip", "content": contents})

    return files.select("name", "raw").mapInPandas(packed, "path string, content binary")


def gexf(g: Graph) -> DataFrame:
    """(part, seq, line): the lines of a GEXF 1.3 file; sort by (part, seq). Pairs appear in both directions; edges of unknown ends are left out."""
    spark = g.spark
    fixed = spark.createDataFrame(
        [
            (0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (1, "", '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'),
            (2, "", '<attributes class="node"><attribute id="label" title="label" type="string"/><attribute id="type" title="entity_type" type="string"/></attributes><nodes>'),
            (4, "", "</nodes><edges>"), (6, "", "</edges></graph></gexf>"),
        ],
        "part int, seq string, line string",
    )
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in (("Message", "0"), ("Entity", "1"), ("Keyword", "2"), ("Conversation", "3")) for x in (k, v)]), F.col("label"))
    shown = F.coalesce(F.nullif("name", F.lit("")), F.nullif(F.substring("text", 1, 80), F.lit("")), F.col("id"))
    node = F.format_string(
        '<node id="%s" label="%s"><attvalues><attvalue for="label" value="%s"/><attvalue for="type" value="%s"/></attvalues></node>',
        xml_text(F.col("id")), xml_text(shown), F.col("label"), xml_text(F.col("entity_type")),
    )
    nodes = g.nodes.select(F.lit(3).alias("part"), F.concat(rank, "id").alias("seq"), node.alias("line"))
    one = F.lit(1.0)
    e = (
        g.contains.select(F.col("conv_id").alias("s"), F.col("msg_id").alias("t"), F.lit("CONTAINS").alias("k"), one.alias("w"))
        .unionByName(g.replies.select(F.col("parent_id").alias("s"), F.col("child_id").alias("t"), F.lit("REPLIES_TO").alias("k"), one.alias("w")))
        .unionByName(g.mentions.select(F.col("msg_id").alias("s"), F.col("entity_id").alias("t"), F.lit("MENTIONS").alias("k"), one.alias("w")))
        .unionByName(g.cooc.select(F.col("entity_a").alias("s"), F.col("entity_b").alias("t"), F.lit("CO_OCCURS_WITH").alias("k"), F.col("weight").cast("double").alias("w")))
        .unionByName(g.cooc.select(F.col("entity_b").alias("s"), F.col("entity_a").alias("t"), F.lit("CO_OCCURS_WITH").alias("k"), F.col("weight").cast("double").alias("w")))
        .unionByName(g.keywords.select(F.col("msg_id").alias("s"), F.col("keyword_id").alias("t"), F.lit("HAS_KEYWORD").alias("k"), F.col("weight").alias("w")))
    )
    ids = g.nodes.select("id")
    known = e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi")
    key = F.concat_ws("|", "k", "s", "t")
    line = F.format_string('<edge id="%s" source="%s" target="%s" kind="%s" weight="%s"/>', xml_text(key), xml_text(F.col("s")), xml_text(F.col("t")), F.col("k"), F.col("w").cast("string"))
    return fixed.unionByName(nodes).unionByName(known.select(F.lit(5).alias("part"), key.alias("seq"), line.alias("line")))


def write_gexf(g: Graph, path: str) -> None:
    """Range-sorted part files whose names are in file order; a reader concatenates them."""
    gexf(g).orderBy("part", "seq").select("line").write.mode("overwrite").text(path)


def write_bulk(g: Graph, path: str) -> None:
    """One CSV folder per node label and per relation, as graph databases load them."""
    for label in ("Conversation", "Message", "Entity", "Keyword"):
        g.of(label).drop("label").write.mode("overwrite").options(**CSV).csv(f"{path}/nodes/{label}")
    for t in ("contains", "replies", "mentions", "cooc", "keywords"):
        getattr(g, t).write.mode("overwrite").options(**CSV).csv(f"{path}/edges/{t}")


def graph_dict(g: Graph) -> DataFrame:
    """(id, attrs): node attributes as JSON without empty and zero values."""
    keep = lambda c: F.when(F.col(c) != "", F.col(c))
    attrs = F.struct("label", *[keep(c).alias(c) for c in ("role", "text", "name", "entity_type")], F.when(F.col("create_time") != 0, F.col("create_time")).alias("create_time"))
    return g.nodes.select("id", F.to_json(attrs).alias("attrs"))


def write_report(df: DataFrame, path: str, digits: int = 4) -> None:
    """A report as CSV with a header; doubles with a fixed number of digits and no marks for thousands."""
    def shown(c: str, kind: str) -> Column:
        v = F.col(f"`{c}`")
        return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v)).alias(c) if kind == "double" else v

    df.select(*[shown(c, t) for c, t in df.dtypes]).write.mode("overwrite").options(**CSV).csv(path)


def to_npz(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(path, content): blocks of ids and float vectors as compressed arrays, one per Arrow batch; vectors of one length."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for f in frames:
            if len(f):
                held = io.BytesIO()
                np.savez_compressed(held, ids=f["id"].to_numpy(dtype=str), vectors=np.stack(f["v"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"path": [f"{f['id'].iloc[0]}.npz"], "content": [held.getvalue()]})

    return df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).mapInPandas(packed, "path string, content binary")


def bars(df: DataFrame, value: str, width: int = 40) -> DataFrame:
    """Adds a bar of ``#`` in proportion to the largest value."""
    most = df.agg(F.max(value).alias("_m"))
    return df.join(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("#"), F.round(F.col(value) / F.col("_m") * width).cast("int"))).drop("_m")


def write_lists(docs: DataFrame, path: str) -> None:
    """The JSON texts of the first column as lists, one file a task, in the order of the rows."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = "["
        for f in frames:
            marks = [open_, *[","] * (len(f) - 1)] if len(f) else []
            yield pd.DataFrame({"value": [m + x for m, x in zip(marks, f.iloc[:, 0])]}, dtype=object)
            open_ = "," if marks else open_
        yield pd.DataFrame({"value": ["[]" if open_ == "[" else "]"]})

    docs.select(docs.columns[0]).mapInPandas(lines, "value string").write.text(path)

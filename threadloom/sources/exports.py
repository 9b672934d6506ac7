"""Chat exports as DataFrames: readers, format detection and one parser per provider.

Readers give (path, raw). Parsers give normalised conversations:
id, title, messages array<struct<role, content, created_at, model>>, created_at, updated_at, model, source_format, source_file.
Malformed documents give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import clean_parts, parse_time, seeded_uuid, sha256_hex

MESSAGES = "array<struct<role:string,content:string,created_at:double,model:string>>"
_NODE = (
    "struct<message:struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>,create_time:string>,parent:string>"
)
EXPORT = f"struct<conversation_id:string,id:string,title:string,mapping:map<string,{_NODE}>>"
_ANTHROPIC = (
    "struct<uuid:string,name:string,created_at:string,updated_at:string,"
    "chat_messages:array<struct<text:string,sender:string,created_at:string,content:array<struct<text:string>>>>>"
)
_ARRAY = (
    "struct<id:string,chatGroupId:string,role:string,model:string,displayModel:string,created_at:string,"
    "contents:array<struct<type:string,content:string,attachment:struct<name:string>>>>"
)
#: How tables are written as CSV and read back: quotes are doubled, line breaks and outer blanks survive.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "multiLine": True}
ROLES = {"you": "user", "human": "user", "user": "user", "chatgpt": "assistant", "assistant": "assistant"}


def read_files(spark: SparkSession, paths: list[str] | str, recursive: bool = False, pattern: str = "*.json") -> DataFrame:
    """(path, raw): one row per file, read by Spark, so any store works."""
    # ``text`` would set an option of that name back to its own default
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def collect_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All .json and .md files below the paths."""
    return read_files(spark, paths, True, "*.json").unionByName(read_files(spark, paths, True, "*.md"))


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, raw): one row per .json member of every archive of (path, content); a broken archive gives no rows."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                with z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".json")):
                        yield pd.DataFrame({"path": [f"{path}!{name}"], "raw": [z.read(name).decode("utf-8", "replace")]})

    return archives.select("path", "content").mapInPandas(members, "path string, raw string")


def read_zips(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, raw): one row per .json member of every archive."""
    return zip_members(spark.read.format("binaryFile").load(paths))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV folder of the sinks with a declared schema; CSV cannot tell an empty string from null, so both come back as null."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def npz_rows(archives: DataFrame) -> DataFrame:
    """(id, vector): the rows of every compressed block of (path, content)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for f in frames:
            for content in f["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"id": z["ids"].astype(str), "vector": list(z["vectors"])})

    return archives.select("content").mapInPandas(rows, "id string, vector array<float>")


def nodes_of_dicts(rows: DataFrame) -> DataFrame:
    """Nodes from (id, attrs), attributes as JSON: what is missing becomes an empty string, or null for the time."""
    kinds = "label string, role string, text string, name string, entity_type string, create_time double"
    a = rows.select("id", F.from_json("attrs", kinds).alias("a"))
    kept = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c)
    return a.select("id", F.col("a.label").alias("label"), *[kept(c) for c in ("role", "text", "name", "entity_type")], F.col("a.create_time").alias("create_time"))


def conversations(files: DataFrame, schema: str = EXPORT) -> DataFrame:
    """(path, pos, c): every conversation of every file, whether the file holds one or a list.

    ``files`` may also hold the values of such lists one by one (path, pos, raw), as ``splits.read_elements`` gives them.
    """
    if "pos" in files.columns:
        return files.select("path", "pos", F.from_json("raw", schema).alias("c")).where("c is not null")
    raw = F.ltrim("raw")
    many = F.from_json("raw", f"array<{schema}>")
    one = F.from_json("raw", schema)
    listed = F.when(raw.startswith("["), many).when(raw.startswith("{"), F.array(one))
    return files.select("path", F.posexplode(listed).alias("pos", "c")).where("c is not null")


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "[/!]"), -1), r"\.[^.]*$", "")


def extract(files: DataFrame) -> DataFrame:
    """Message rows of mapping exports: text parts without noise, joined by newlines; ``seq`` is the order of reading."""
    rows = conversations(files).where("c.mapping is not null").select(
        "path", "pos", F.coalesce("c.conversation_id", "c.id", stem(F.col("path"))).alias("conversation_id"), F.posexplode("c.mapping").alias("at", "id", "node")
    )
    text = rows.where("node.message is not null and node.message.content.content_type = 'text'")
    return text.select(
        "id", F.coalesce("node.message.author.role", F.lit("unknown")).alias("role"),
        F.array_join(clean_parts(F.coalesce("node.message.content.parts", F.array().cast("array<string>"))), "\n").alias("text"),
        F.col("node.parent").alias("parent"), parse_time(F.col("node.message.create_time")).alias("create_time"), "conversation_id",
        F.struct("path", "pos", "at").alias("seq"),
    )


_KEYS = ("mapping", "conversation_id", "id", "uuid", "chat_messages", "exportDate", "conversations", "role", "contents", "model", "chatGroupId")


def detect_format(raw: Column, path: Column) -> Column:
    """Name of the export format by the keys of the document or of its first element, parsed once; first match wins."""
    is_list = F.ltrim(raw).startswith("[")
    one = "struct<" + ", ".join(f"{k}: string" for k in _KEYS) + ">"
    keys = F.when(is_list, F.get(F.from_json(raw, f"array<{one}>"), F.lit(0))).otherwise(F.from_json(raw, one))

    def named(k: Column) -> Column:
        has = lambda *names: F.lit(True) if not names else k[names[0]].isNotNull() & has(*names[1:])
        array = is_list & has("role", "contents")
        return (
            F.when(~is_list & has("mapping") & (has("conversation_id") | has("id")), "openai_individual")
            .when(~is_list & has("uuid", "chat_messages"), "anthropic_individual")
            .when(~is_list & has("exportDate", "conversations"), "chatgpt_export_summary")
            .when(is_list & has("conversation_id", "mapping"), "openai_master")
            .when(is_list & has("uuid", "chat_messages"), "anthropic_master")
            .when(array & (k["model"] == "deepseek"), "deepseek")
            .when(array & (k["model"] == "gemini"), "gemini")
            .when(array & k["id"].startswith("claude_"), "singles_claude")
            .when(array & has("chatGroupId"), "generic_message_array")
            .otherwise("unknown")
        )

    return F.when(path.endswith(".md"), "openai_md").otherwise(F.get(F.transform(F.array(keys), named), F.lit(0)))


def _message(role: Column, content: Column, at: Column, model: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"), at.alias("created_at"), model.cast("string").alias("model"))


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    null = F.lit(None)
    full = {"created_at": null.cast("double"), "updated_at": null.cast("double"), "model": null.cast("string"), "source_file": F.lit("")} | cols
    order = ("id", "title", "messages", "created_at", "updated_at", "model", "source_format", "source_file")
    return df.select(*[(full[c].cast(MESSAGES) if c == "messages" else full[c]).alias(c) for c in order])


def parse_anthropic(files: DataFrame) -> DataFrame:
    """``text``, or else the texts of the content blocks; every sender but the assistant is the user."""
    null = F.lit(None)

    def message(m: Column) -> Column:
        blocks = F.array_join(F.transform(F.coalesce(m["content"], F.array().cast("array<struct<text:string>>")), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
        role = F.when(m["sender"] == "assistant", "assistant").otherwise("user")
        return _message(role, F.coalesce(F.nullif(m["text"], F.lit("")), blocks), parse_time(m["created_at"]), null)

    rows = conversations(files, _ANTHROPIC).where("c.uuid is not null or c.chat_messages is not null")
    none = F.array().cast(MESSAGES)
    return _shape(
        rows, id=F.coalesce("c.uuid", seeded_uuid(F.concat("path", "pos"))), title=F.coalesce("c.name", F.lit("")),
        messages=F.coalesce(F.transform("c.chat_messages", message).cast(MESSAGES), none),
        created_at=parse_time(F.col("c.created_at")), updated_at=parse_time(F.col("c.updated_at")), source_format=F.lit("anthropic"),
    )


def parse_message_array(files: DataFrame) -> DataFrame:
    """One row per chat group; text, markdown and thinking blocks and names of attachments; blank messages go."""
    kind = F.col("format") if "format" in files.columns else detect_format(F.col("raw"), F.col("path"))
    rows = conversations(files.withColumn("path", F.to_json(F.struct("path", kind.alias("f")))), _ARRAY)
    shown = F.transform(
        F.coalesce("c.contents", F.array().cast("array<struct<type:string,content:string,attachment:struct<name:string>>>")),
        lambda x: F.when(x["type"].isin("text", "markdown", "thinking"), F.coalesce(x["content"], F.lit(""))).when(
            (x["type"] == "attachment") & (x["attachment"]["name"] != ""), F.concat(F.lit("[Attachment: "), x["attachment"]["name"], F.lit("]"))
        ),
    )
    text = F.trim(F.array_join(F.filter(shown, lambda x: x.isNotNull()), "\n"), F.lit(" \t\n\r"))
    at = parse_time(F.col("c.created_at"))
    m = rows.select(
        "path", "pos", F.coalesce("c.chatGroupId", seeded_uuid(F.concat("path", "pos"))).alias("id"), F.col("c.model").alias("first_model"),
        _message(F.coalesce("c.role", F.lit("user")), text, at, F.coalesce(F.nullif("c.model", F.lit("")), "c.displayModel")).alias("m"),
    )
    real = F.when(F.col("m.content") != "", F.struct("pos", "m"))
    g = m.groupBy("path", "id").agg(
        F.sort_array(F.collect_list(real)).alias("ms"), F.min(F.when(F.col("m.content") != "", F.col("m.created_at"))).alias("created_at"),
        F.max(F.when(F.col("m.content") != "", F.col("m.created_at"))).alias("updated_at"), F.min_by("first_model", "pos").alias("model"),
    )
    title = F.get(F.filter("ms", lambda x: x["m"]["role"] == "user"), F.lit(0))["m"]["content"]
    name = F.get_json_object("path", "$.f")
    return _shape(
        g, id=F.col("id"), title=F.trim(F.coalesce(F.substring(title, 1, 80), F.lit(""))), messages=F.transform("ms", lambda x: x["m"]),
        created_at=F.col("created_at"), updated_at=F.col("updated_at"), model=F.col("model"),
        source_format=F.when(name == "generic_message_array", "generic").otherwise(name),
    )


def parse_markdown(files: DataFrame) -> DataFrame:
    """``# title`` (the last one), ``#### You:`` sections; what stands before the first section is left out."""
    lines = files.select("path", F.posexplode(F.split("raw", "\n", -1)).alias("at", "line"))
    head = F.lower(F.regexp_extract("line", r"(?i)^####\s+(You|ChatGPT|Human|Assistant|User):\s*$", 1))
    title = F.regexp_extract("line", r"^#\s+(.+)$", 1)
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    # a message is an island of lines: the number of headings up to a line tells which
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumn("head", head).withColumn("title", title).withColumn("part", F.sum((F.col("head") != "").cast("int")).over(so_far))
    body = F.when((F.col("head") == "") & (F.col("title") == ""), F.struct("at", "line"))
    null = F.lit(None)
    parts = seen.groupBy("path", "part").agg(
        F.max(F.try_element_at(roles, F.nullif("head", F.lit("")))).alias("role"), F.sort_array(F.collect_list(body)).alias("ls"),
        F.max_by(F.trim("title"), F.when(F.col("title") != "", F.col("at"))).alias("title"), F.max(F.when(F.col("title") != "", F.col("at"))).alias("title_at"),
    )
    content = F.trim(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(" \t\n\r"))
    message = F.when((F.col("part") > 0) & (content != ""), F.struct("part", _message(F.col("role"), content, null.cast("double"), null).alias("m")))
    got = parts.groupBy("path").agg(F.sort_array(F.collect_list(message)).alias("sorted"), F.coalesce(F.max_by("title", "title_at"), F.lit("")).alias("g_title"))
    ms = F.transform("sorted", lambda x: x["m"])
    named = got.select("path", F.col("g_title").alias("t"), ms.alias("ms"))
    first = F.coalesce(F.substring(F.get("ms", F.lit(0))["content"], 1, 80), F.lit(""))
    return _shape(
        named, id=seeded_uuid(F.col("path")), title=F.when(F.col("t") != "", F.col("t")).otherwise(first), messages=F.col("ms"),
        source_format=F.lit("openai_md"), source_file=F.col("path"),
    )


def parse_openai(files: DataFrame) -> DataFrame:
    """Breadth first from the first root, children by time; in a kernel, as chains may be any length."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for raw in f["raw"]:
                try:
                    data = json.loads(raw)
                except ValueError:
                    continue
                for c in data if isinstance(data, list) else [data]:
                    nodes = c.get("mapping") if isinstance(c, dict) else None
                    if nodes:
                        found.append(json.dumps({k: c.get(k) for k in ("conversation_id", "id", "title", "create_time", "update_time")} | {"ms": _in_order(nodes)}))
            yield pd.DataFrame({"c": found}, dtype=object)

    schema = (
        "struct<conversation_id:string,id:string,title:string,create_time:string,update_time:string,"
        "ms:array<struct<role:string,content:string,created_at:string,model:string>>>"
    )
    rows = files.select("raw").mapInPandas(kernel, "c string").select(F.from_json("c", schema).alias("c")).where("c.ms is not null")
    return _shape(
        rows, id=F.coalesce("c.conversation_id", "c.id", seeded_uuid(F.to_json("c"))), title=F.coalesce("c.title", F.lit("")),
        messages=F.transform("c.ms", lambda m: _message(m["role"], m["content"], parse_time(m["created_at"]), m["model"])),
        created_at=parse_time(F.col("c.create_time")), updated_at=parse_time(F.col("c.update_time")), source_format=F.lit("openai"),
    )


def _in_order(nodes: dict) -> list[dict] | None:
    root = next((k for k, n in nodes.items() if isinstance(n, dict) and n.get("parent") is None), None)
    if root is None:
        return None
    clock = lambda k: ((nodes.get(k) or {}).get("message") or {}).get("create_time") or 0
    level, seen, out = [root], {root}, []
    while level:
        below = []
        for k in level:
            node = nodes.get(k) or {}
            m = node.get("message") or {}
            text = "".join(str(p or "") for p in (m.get("content") or {}).get("parts") or []).strip()
            if text:
                role = (m.get("author") or {}).get("role")
                out.append({"role": role if role in ("user", "assistant") else "user", "content": text, "created_at": m.get("create_time"), "model": (m.get("metadata") or {}).get("model_slug")})
            fresh = [x for x in sorted(node.get("children") or [], key=clock) if x not in seen]
            seen.update(fresh)
            below += fresh
        level = below
    return out


PARSERS = {
    "openai_md": parse_markdown,
    "openai_individual": parse_openai,
    "openai_master": parse_openai,
    "anthropic_individual": parse_anthropic,
    "anthropic_master": parse_anthropic,
    "deepseek": parse_message_array,
    "gemini": parse_message_array,
    "singles_claude": parse_message_array,
    "generic_message_array": parse_message_array,
}


def parse(files: DataFrame) -> DataFrame:
    """Every file by the parser of its format; unknown formats and summaries give nothing."""
    # the place column keeps the format's many looks at ``raw`` from being pushed into whatever made ``raw``
    placed = files.select("path", "raw", F.monotonically_increasing_id().alias("_at"))
    known = placed.withColumn("format", detect_format(F.col("raw"), F.col("path"))).where("_at >= 0")
    out = None
    for f in dict.fromkeys(PARSERS.values()):
        names = [k for k, v in PARSERS.items() if v is f]
        part = f(known.where(F.col("format").isin(*names)).select("path", "raw"))
        out = part if out is None else out.unionByName(part)
    return out


def content_hash(title: Column, messages: Column) -> Column:
    """SHA-256 over title, roles and stripped contents."""
    body = F.flatten(F.transform(messages, lambda m: F.array(m["role"], F.trim(m["content"], F.lit(" \t\n\r")))))
    return sha256_hex(F.array_join(F.concat(F.array(title), body), "\n"))


def dedup_conversations(convs: DataFrame) -> DataFrame:
    """One conversation of each content; the smallest id stays."""
    h = convs.withColumn("_h", content_hash(F.col("title"), F.col("messages")))
    first = h.groupBy("_h").agg(F.min(F.struct("id", "source_file")).alias("_f"))
    return h.withColumn("_f", F.struct("id", "source_file")).join(first, ["_h", "_f"], "left_semi").dropDuplicates(["_h"]).drop("_h", "_f")

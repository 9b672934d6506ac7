"""WARC archives: index first, then coalesced reads of the byte ranges of selected records.

Writing. Each task writes its records, one gzip member each, to files of its own, and returns an index row per record:
file, offset, length, id, URL, type and payload digest. The index, a table in the shared folder, is what commits: a task
that is repeated or lost leaves a file that no row of the index names. Equal payloads of ``least`` bytes or more are
written once: the record with the largest id is a ``response``, the others are ``revisit`` records that name it.

Reading. Rows of the index are selected first, by any condition on it. Those that lie close together are dealt to one
task and sorted by offset; ranges less than ``GAP`` bytes apart become one read of at most ``SPAN`` bytes. Payloads are
checked against their digests. Archives without an index are indexed by ``index_archives``, which reads every member once.

Archives are read and written through ``pyarrow.fs``, so their folder must be one that it reaches from every executor
(a shared disk, an object store, HDFS).

Defined results: a null payload is empty; a null URL is left out of the record and reads back as null, control characters
in one are percent-encoded; a null id is written as ``none`` and reads back as null, and never names a response unless a
payload has no other id (then all its records are responses); rows that repeat the largest id of a payload are all
responses; a payload is held whole by the task that writes or reads it; an empty table gives no record; extra columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import join_spread, materialise, own_folder, table

#: A task starts a new archive beyond so many bytes.
ARCHIVE = 1 << 30
#: Ranges at most so far apart are read together, up to so many bytes at once; a task's share of an archive.
GAP = 1 << 16
SPAN = 1 << 23
BLOCK = 1 << 26
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset bigint, length bigint, id string, url string, record_type string, payload_digest string"
_RECORD = "id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def _store(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [("WARC-Type", kind), ("WARC-Date", now), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def _name(key: str | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def _key(name: str | None) -> str | None:
    key = name and name.removeprefix("<urn:page:").removesuffix(">")
    return None if key in (None, "none") else key


def _url(url: str | None) -> str | None:
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(key: str | None, url: str | None, payload: bytes, refers: str | None) -> tuple[bytes, str]:
    """One gzip member and the payload's digest; a revisit (``refers``) keeps the head of the answer alone."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", _name(key)), ("WARC-Target-URI", _url(url)), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is None:
        return _member("response", fields, http + payload), own
    return _member("revisit", [*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers))], http), own


def parsed(member: bytes) -> dict:
    """Fields of a record, and its payload where it has one, which must have the digest that the record states."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    out = {
        "id": _key(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": _key(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": None, "payload": None,
    }
    if out["record_type"] in ("response", "revisit"):
        answer, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", answer)
        out["payload_bytes"] = int(said[1]) if said else len(payload)
        if out["record_type"] == "response":
            if out["payload_digest"] not in (None, digest(payload)) or len(payload) != out["payload_bytes"]:
                raise ValueError(f"record {out['id']}: the payload is not the one that was written")
            out["payload"] = payload
    return out


def _batch(rows: list[dict], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in schema.items()], list(schema))


def _types(ddl: str) -> dict[str, pa.DataType]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return {name: kinds[kind] for name, kind in (x.split() for x in ddl.split(","))}


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                payloads = b.column("payload")
                for k, (key, url, refers) in enumerate(zip(*[b.column(c).to_pylist() for c in ("id", "url", "refers_to")])):
                    if out is None or at >= most:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        at = out.write(_member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    member, own = record(key, url, payloads[k].as_py(), refers)
                    out.write(member)
                    kind = "response" if refers is None else "revisit"
                    rows.append({"file": name, "offset": at, "length": len(member), "id": key, "url": url, "record_type": kind, "payload_digest": own})
                    at += len(member)
                yield _batch(rows, _types(_INDEX))
        finally:
            if out is not None:
                out.close()

    return run


def ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length), ...]) of sorted (file, offset, length): one read for records that lie close together."""
    name, start, end, held = None, 0, 0, []
    for file, offset, length in rows:
        if held and (file != name or offset - end > gap or offset + length - start > span):
            yield name, start, end, held
            held = []
        if not held:
            name, start, end = file, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield name, start, end, held


def _reader(folder: str, payloads: bool):
    schema = _types(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "length")]))
        opened, name = None, None
        for file, start, end, members in ranges(rows):
            if file != name:
                if opened is not None:
                    opened.close()
                opened, name = store.open_input_file(f"{root}/{file}"), file
            data = opened.read_at(end - start, start)
            found = [parsed(data[o - start : o - start + n]) for o, n in members]
            if not payloads:
                for r in found:
                    r["payload"] = None
            yield _batch(found, schema)
        if opened is not None:
            opened.close()

    return run


def _members(source, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, gzip member) of an archive, read once from front to end; one member is held at a time."""
    at, data, part = 0, b"", source.read(step)
    while part or data:
        unpack, used = zlib.decompressobj(31), 0
        member = bytearray()
        data = data or part
        while True:
            unpack.decompress(data)
            left = len(unpack.unused_data)
            member += data[: len(data) - left] if left else data
            if unpack.eof:
                break
            data = source.read(step)
            if not data:
                raise ValueError("the archive ends within a record")
        yield at, bytes(member)
        at += len(member)
        data = unpack.unused_data
        part = b"" if data else source.read(step)


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                name = path.rsplit("/", 1)[1]
                with store.open_input_file(f"{root}/{name}") as source:
                    for offset, member in _members(source):
                        r = parsed(member)
                        if r["record_type"] != "warcinfo":
                            yield _batch([r | {"file": name, "offset": offset, "length": len(member)}], _types(_INDEX))

    return run


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """(id, url, payload, refers_to) of ``pages`` (page_id, url, html): revisits refer to the largest id of their payload.

    Payloads are told apart by SHA-256. Those of very many records stay where they are (``join_spread``).
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least)
    originals = materialise(long.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")))
    total = originals.agg(F.sum("n")).first()[0] or 0
    named = join_spread(long, originals, "sha", total).unionByName(rows.where(F.octet_length("payload") < least).withColumn("original", F.col("page_id")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return named.select(F.col("page_id").cast("string").alias("id"), "url", "payload", refers.cast("string").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, most: int = ARCHIVE) -> DataFrame:
    """Writes ``records`` (id, url, payload, refers_to) as archives in ``folder`` and returns their index, which commits them."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return materialise(records.select("id", "url", "payload", "refers_to").mapInArrow(_writer(folder, most), _INDEX))


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of archives in ``folder``, read off the archives; a gzip archive has no other way in than its front."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    return materialise(files.repartition(F.col("path")).mapInArrow(_indexer(folder), _INDEX))


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``selected`` rows of an index, by coalesced reads; a task reads a stretch of an archive in order."""
    near = selected.select("file", "offset", "length", F.floor(F.col("offset") / BLOCK).alias("stretch"))
    return near.repartition("file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(_reader(folder, payloads), _RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives with an index, and read back from them."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}-warc"
    index = write_archives(with_originals(pages), folder)
    kind = dict(pages.dtypes)["page_id"]
    return read_records(index, folder, payloads=False).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url"
    )


ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as h from pages),
d as (select *, sha1(h) as x, max(page_id) over (partition by h) as original from p)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ((strpos('0123456789abcdef', substr(x, 1 + ((5 * i) // 4)::int, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, 2 + ((5 * i) // 4)::int, 1)) - 1)
    // (2 ** (3 - (5 * i) % 4))::bigint % 32)::int, 1)), '') as payload_digest,
  case when page_id is not distinct from original then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from original then original end as refers_to,
  regexp_replace(url, ' ', '%20', 'g') as url
from d
"""

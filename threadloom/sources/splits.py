"""JSON exports of any size: a file is cut into byte ranges, and a task reads the values that start in its range.

A range does not know whether it starts inside a string, nor how deep. So it is scanned once for both cases: the parity
of its quotes, and for either case how far the depth moves and how many commas stand at each depth. These summaries are
small, and running sums over a file's ranges give every range its true state: inside a string or not, the depth, and the
number of list elements before it. A second pass cuts out the elements: a value belongs to the range that holds the
bracket or comma before it, and its task reads on beyond the range until the value ends. A task so holds one block of
``BLOCK`` bytes and one element, whatever the size of the file.

Files are listed by Spark and read through ``pyarrow.fs``. A file holds one object or one list. Blank files, files of
other values, and files that end within a string or a bracket give no rows; an element that is not JSON comes as it is,
and the parsers leave it out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.session import durable
from threadloom.sources.exports import detect_format

RANGE = 32 << 20
BLOCK = 4 << 20
#: Bytes of elements that one batch of rows holds, about.
_BATCH = 8 << 20
_QUOTE, _SLASH, _COMMA, _OPEN, _CLOSE = b'"'[0], b"\\"[0], b","[0], (b"["[0], b"{"[0]), (b"]"[0], b"}"[0])


class Source:
    """Blocks of a file by offset."""

    def __init__(self, path: str) -> None:
        store, name = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
        self.file = store.open_input_file(name)

    def blocks(self, start: int, end: int, size: int) -> Iterator[np.ndarray]:
        for at in range(start, end, size):
            yield np.frombuffer(self.file.read_at(min(size, end - at), at), np.uint8)

    def slashes(self, at: int, size: int) -> int:
        """Backslashes right before ``at``."""
        n = 0
        while at > n:
            b = np.frombuffer(self.file.read_at(min(size, at - n), max(0, at - n - size)), np.uint8)
            other = np.flatnonzero(b != _SLASH)
            n += len(b) - 1 - int(other[-1]) if len(other) else len(b)
            if len(other):
                break
        return n


class Marks:
    """Quotes and structure of a stretch, block by block. ``inside``: the stretch starts within a string."""

    def __init__(self, slashes: int, inside: bool) -> None:
        self.slashes, self.inside = slashes, inside

    def of(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of brackets and commas, whether each stands outside of strings, and the number of quotes."""
        quotes = np.flatnonzero(block == _QUOTE)
        slash = np.flatnonzero(block == _SLASH)
        if len(slash) or self.slashes:
            # a quote after an odd run of backslashes is text
            first = np.ones(len(slash), bool)
            first[1:] = slash[1:] != slash[:-1] + 1
            head = slash[first]
            which = np.searchsorted(slash, quotes) - 1
            ends = (which >= 0) & (slash[np.maximum(which, 0)] == quotes - 1) if len(slash) else np.zeros(len(quotes), bool)
            run = np.zeros(len(quotes), np.int64)
            if ends.any():
                start = head[np.searchsorted(head, quotes[ends], "right") - 1]
                run[ends] = quotes[ends] - start + np.where(start == 0, self.slashes, 0)
            run[quotes == 0] = self.slashes
            quotes = quotes[run % 2 == 0]
            tail = len(block) - 1 - int(np.flatnonzero(block != _SLASH)[-1]) if (block != _SLASH).any() else len(block) + self.slashes
            self.slashes = tail
        at = np.flatnonzero((block == _COMMA) | (block == _OPEN[0]) | (block == _OPEN[1]) | (block == _CLOSE[0]) | (block == _CLOSE[1]))
        outside = (np.searchsorted(quotes, at) + self.inside) % 2 == 0
        self.inside = bool((len(quotes) + self.inside) % 2)
        return at, outside, len(quotes)


def _steps(kinds: np.ndarray) -> np.ndarray:
    return np.isin(kinds, _OPEN).astype(np.int64) - np.isin(kinds, _CLOSE)


_SUMMARY = "path string, start bigint, parity int, delta array<bigint>, commas array<map<bigint, bigint>>, first string"


def _summary(size: int):
    """For a start outside and within a string: where the depth goes, and commas by depth."""
    commas = pa.list_(pa.map_(pa.int64(), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*[b.column(c).to_pylist() for c in ("path", "start", "end")]):
                source = Source(path)
                marks, depth, seen, parity, first = Marks(source.slashes(start, size), False), [0, 0], [{}, {}], 0, None
                for block in source.blocks(start, end, size):
                    if first is None:
                        text = bytes(block).lstrip()
                        first = chr(text[0]) if text else None
                    at, outside, quotes = marks.of(block)
                    parity += quotes
                    for case in (0, 1):
                        kinds = block[at[outside if not case else ~outside]]
                        levels = depth[case] + np.cumsum(_steps(kinds))
                        for level, n in zip(*np.unique(levels[kinds == _COMMA], return_counts=True)):
                            seen[case][int(level)] = seen[case].get(int(level), 0) + int(n)
                        depth[case] = int(levels[-1]) if len(levels) else depth[case]
                row = [[path], [start], [parity % 2], [depth], [[list(x.items()) for x in seen]], [first]]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), commas, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["path", "start", "parity", "delta", "commas", "first"])

    return run


def elements_from(source: Source, start: int, end: int, length: int, inside: bool, depth: int, pos: int, listed: bool, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place in the list, text) of every value that follows a bracket or comma of the range; of an object file, the object."""
    marks, held, at, open_ = Marks(source.slashes(start, size), inside), [], start, False
    level = 1 if listed else 0
    for block in source.blocks(start, length, size):
        places, outside, _ = marks.of(block)
        places = places[outside]
        kinds = block[places]
        levels = depth + np.cumsum(_steps(kinds))
        depth = int(levels[-1]) if len(levels) else depth
        opens, closes = np.isin(kinds, _OPEN), np.isin(kinds, _CLOSE)
        if listed:
            cut = (opens & (levels == 1)) | (closes & (levels == 0)) | ((kinds == _COMMA) & (levels == level))
        else:
            cut = (opens & (levels == 1)) | (closes & (levels == 0))
        last = 0
        for k in np.flatnonzero(cut):
            p = int(places[k])
            if open_:
                held.append(bytes(block[last : p + (not listed)]))
                text = b"".join(held)
                if text.strip() or kinds[k] == _COMMA:
                    yield pos, text
                held, open_ = [], False
            if kinds[k] == _COMMA:
                pos += 1
            if at + p >= end:
                return
            if not closes[k]:
                open_, last = True, p + listed
        if open_:
            held.append(bytes(block[last:]))
        at += len(block)
        if at >= end and not open_:
            return


_ELEMENT = "path string, pos bigint, format string, raw string"


def _cut(size: int):
    names = ["path", "pos", "format", "raw"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*cols[:3], cols[3].view(pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("path", "start", "end", "length", "inside", "depth", "pos", "listed", "format")
        rows, held = [], 0
        for b in batches:
            for path, start, end, length, inside, depth, pos, listed, kind in zip(*[b.column(c).to_pylist() for c in columns]):
                for place, text in elements_from(Source(path), start, end, length, inside, depth, pos, listed, size):
                    rows.append((path, place, kind, text))
                    held += len(text)
                    if held >= _BATCH:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def byte_ranges(spark: SparkSession, paths: list[str] | str, recursive: bool = False, pattern: str = "*.json", size: int = RANGE) -> DataFrame:
    """(path, start, end, length): the files below ``paths`` in ranges of ``size`` bytes; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(paths)
    files = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length")).where("length > 0")
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))))
    return cut.select("path", "start", F.least(F.col("start") + size, "length").alias("end"), "length")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges one by one to the session's tasks, as each stands for many bytes."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def located(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The ranges with their state: inside a string, depth, list elements before, list or object, and the file's format."""
    found = durable(_dealt(ranges).mapInArrow(_summary(block), _SUMMARY))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    case = F.col("inside").cast("int")
    rows = found.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("delta", F.get("delta", case)).withColumn("commas", F.get("commas", case))
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    rows = rows.withColumn("own", F.coalesce(F.try_element_at("commas", F.lit(1) - F.col("depth")), F.lit(0)))
    rows = rows.withColumn("pos", F.coalesce(F.sum("own").over(before), F.lit(0)))
    rows = rows.withColumn("kind", F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))).over(whole))
    closed = (F.sum("parity").over(whole) % 2 == 0) & (F.sum("delta").over(whole) == 0)
    rows = rows.withColumn("closed", closed).where(F.col("closed") & F.col("kind").isin("[", "{"))
    state = ranges.join(rows.select("path", "start", "inside", "depth", "pos", (F.col("kind") == "[").alias("listed")), ["path", "start"])
    return durable(state.withColumn("format", F.lit(None).cast("string")))


def elements(state: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, pos, format, raw): the values of located ranges."""
    return _dealt(state).mapInArrow(_cut(block), _ELEMENT).where("trim(raw) <> ''")


def with_formats(state: DataFrame, block: int = BLOCK) -> DataFrame:
    """Located ranges with the export format of their file, told from its first value alone."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, listed in zip(*[b.column(c).to_pylist() for c in ("path", "length", "listed")]):
                _, text = next(elements_from(Source(path), 0, length, length, False, 0, 0, listed, block), (0, b""))
                raw = b"[" + text + b"]" if listed else text
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([raw], pa.binary()).view(pa.string())], ["path", "raw"])

    heads = _dealt(state.where("start = 0")).mapInArrow(first, "path string, raw string")
    named = durable(heads.select("path", detect_format(F.col("raw"), F.col("path")).alias("format")))
    return durable(state.drop("format").join(named, "path"))


def read_elements(spark: SparkSession, paths: list[str] | str, recursive: bool = False, pattern: str = "*.json", size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(path, pos, format, raw): every conversation or message of every file below ``paths``, in as many tasks as there are ranges."""
    return elements(located(byte_ranges(spark, paths, recursive, pattern, size), block), block)


def parse_exports(spark: SparkSession, paths: list[str] | str, recursive: bool = False, pattern: str = "*.json", size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """Normalised conversations of every file, each read by the parser of its format alone."""
    from threadloom.sources.exports import PARSERS

    state = with_formats(located(byte_ranges(spark, paths, recursive, pattern, size), block), block)
    out = None
    for parser in dict.fromkeys(PARSERS.values()):
        names = [k for k, v in PARSERS.items() if v is parser and k != "openai_md"]
        if names:
            part = parser(elements(state.where(F.col("format").isin(*names)), block))
            out = part if out is None else out.unionByName(part)
    return out

"""Shared helpers: table access, reliable materialisation, small native column tools."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words where a contract says ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
#: Folders of intermediate tables that this process has made.
_MADE: set[str] = set()
#: Where each intermediate table stands.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where the session names none and runs inside one process (``local``: tests) a temporary folder is made and set;
    on a cluster executors could not read it, so there a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate data in the shared folder; it goes when the driver ends."""
    own = f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}"
    if own not in _MADE:
        _MADE.add(own)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(hadoop)
        store.deleteOnExit(hadoop)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, and a lost executor costs nothing that was written. All such tables of an application stand in
    one folder, which goes when the driver ends.
    """
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` returned; nothing may read them later, nor what was derived from them lazily."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PLACES.pop(df))
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; else they stay until the driver happens to collect garbage.

    Inside, no query runs twice by the same plan, as ``materialise`` and counts plan anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Keys that ``join_spread`` may broadcast at most.
HOT_KEYS = 1 << 14
_LEAST_HOT = 64


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row per key with ``n``, the number of ``rows`` that have it.

    ``total`` is at least the number of ``rows``. A key of more than total / HOT_KEYS of them is hot: there are fewer
    than HOT_KEYS such keys, so they are broadcast and their rows stay where they are. Every other key is a small group
    and goes through a keyed join. Both branches are always planned, and ``n`` is dropped.
    """
    least = max(_LEAST_HOT, -(-total // HOT_KEYS))
    hot, cold = keyed.where(F.col("n") > least).drop("n"), keyed.where(F.col("n") <= least).drop("n")
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return here.unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one native expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    start = F.struct(first.alias("t"), F.array().cast("array<bigint>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        return let(join(acc["t"], x), lambda t: F.struct(t.alias("t"), F.concat(acc["o"], F.array(t)).alias("o")))

    return F.aggregate(values, start, step, lambda acc: acc["o"])


def _running(values: Column, join: Callable[[Column, Column], Column], first: Column, block: int) -> Column:
    """Inclusive prefixes of an array<bigint> under ``join``; two levels, so long arrays stay far from quadratic."""

    def whole(v: Column) -> Column:
        n = F.size(v)
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / F.lit(block)).cast("int")),
            lambda b: F.slice(v, b * F.lit(block) + F.lit(1), F.lit(block)),
        )

        def joined(p: Column) -> Column:
            totals = F.transform(p, lambda x: F.aggregate(x, first, join))
            return let(
                F.concat(F.array(first), _scan(totals, join, first)),
                lambda before: F.flatten(
                    F.transform(p, lambda x, i: F.transform(_scan(x, join, first), lambda y: join(y, F.get(before, i))))
                ),
            )

        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(parts, joined))

    return let(values, whole)


def running_sum(values: Column, block: int = 128) -> Column:
    """Inclusive prefix sums of an array<bigint>."""
    return _running(values, lambda a, b: a + b, F.lit(0).cast("bigint"), block)


def running_max(values: Column, block: int = 128) -> Column:
    """Inclusive prefix maxima of an array<bigint> of whole numbers from 0."""
    return _running(values, lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"), block)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null or blank text has none."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1))

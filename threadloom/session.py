"""A session with the settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "threadloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow for Python kernels; ``conf`` overrides (underscores become dots)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Folders of this process that go when the driver ends.
_MADE: set[str] = set()


def _goes_at_exit(spark: SparkSession, folder: str) -> None:
    if folder not in _MADE:
        _MADE.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; no query may run twice by the same plan there."""
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


#: Where each durable table stands.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def durable(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written as Parquet to the session's shared folder and read back; cuts lineage between iterations.

    A checkpoint would keep the size that Spark guesses for ``df``, a product over all joins: its digits double with every
    round of a loop, until planning takes longer than running. A file has its own size. The folder goes when the driver ends,
    or before by ``release``.
    """
    spark = spark or df.sparkSession
    path = scratch(spark)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what ``durable`` wrote for ``tables``; nothing may read them later, nor what was derived from them lazily."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PLACES.pop(df))
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared one; it goes when the driver ends."""
    own = f"{shared_folder(spark)}/stores-{spark.sparkContext.applicationId}"
    _goes_at_exit(spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Unset, a local session gets a temporary folder; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")

"""Helpers shared by the corpus operators: tables, shared folders, task counts."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z and a-z, for lower-casing ASCII only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine has none (tests) is a temporary
    folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orvane-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the JVM ends."""
    path = f"{shared_dir(spark)}/orvane-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """The pyarrow file system and the path in it (``file://``, ``hdfs://``, ``s3://``, ...)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the column ``text``, from one scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def sorted_by_range(df: DataFrame, per_task: int, rows: int, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Range-partition on ``keys`` into parts of about ``per_task`` rows and sort each by them and ``then``."""
    tasks = max(1, -(-rows // max(1, per_task)), shuffle_tasks(df.sparkSession) if rows > per_task else 1)
    return df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, *then)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on after their task, beside a JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


#: What a worker keeps for the next task of its own operator; work on groups needs none of it.
MODELS: list[dict] = []


def drop_models() -> None:
    for kept in MODELS:
        kept.clear()


def lean(work: Callable) -> Callable:
    """``work`` on a group or on two cogroups, before which models of other operators go and after which free memory is given back."""

    def one(group):
        drop_models()
        try:
            return work(group)
        finally:
            give_back()

    def two(left, right):
        drop_models()
        try:
            return work(left, right)
        finally:
            give_back()

    return one if work.__code__.co_argcount == 1 else two


def lean_batches(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, after which free memory is given back."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def as_nullable(kind: T.DataType) -> T.DataType:
    """A type with every part nullable, as Arrow gives it back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, as_nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(as_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(as_nullable(kind.keyType), as_nullable(kind.valueType))
    return kind


def packed_row(df: DataFrame, *columns: str, **more: Column) -> Column:
    """A struct of columns under the names c0, c1, ... and of further ones, all nullable: it goes through Arrow whatever the names."""
    row = F.struct(*(df[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(columns)), *(c.alias(k) for k, c in more.items()))
    kind = T.StructType([T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(columns)] + [T.StructField(k, df.select(c).schema[0].dataType) for k, c in more.items()])
    return row.cast(as_nullable(kind))

"""What the operators share: staging in the cluster's shared folder and partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


#: Bytes in a batch between Spark and Python; the default of 64 MB is held several times over for each running task.
BATCH_BYTES = 8 << 20

_TABLE: dict = {}

#: Paths of the tables staged within the innermost ``stage_alone``, if any.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)

#: Spark's setting that deletes a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def worker_table(key, make):
    """The one large table that a Python worker keeps between tasks; making another lets it go."""
    if key not in _TABLE:
        _TABLE.clear()
        _TABLE[key] = make()
    return _TABLE[key]


def release() -> None:
    """Lets a worker's table go and gives the pages back that Arrow holds unused, where a stage needs neither."""
    _TABLE.clear()
    pa.default_memory_pool().release_unused()


def prepare(spark: SparkSession) -> None:
    """Ships the package to Python workers and bounds their batches, unless the session sets its own bound."""
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound).rstrip("b") == str(64 << 20):
        spark.conf.set(bound, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and Spark runs in one process (local tests) a temporary folder
    is made and set; a cluster without the setting is an error, as its machines share no such folder.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lumenfold-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if (staged := _STAGED.get()) is not None:
        staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go with its end; a query that runs again over its old plan makes them anew."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """Stages what make returns and deletes all tables that were staged on the way to it, and the shuffle files of each once it is written, so none outlasts its use."""
    outer, path = _STAGED.set(staged := []), None
    try:
        with shuffles_go(spark):
            out, path = stage(make(), label)
    finally:
        _STAGED.reset(outer)
        drop(spark, *(p for p in staged if p != path))
    if (around := _STAGED.get()) is not None:
        around.append(path)
    return out, path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fan_out(df: DataFrame) -> int:
    """Partitions for a shuffle of as many bytes as df reads: never fewer than its scan has."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as the empty text, and further columns; all else is pruned from the scan."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def row_key():
    """Two longs that tell a row by its doc_id and whole text: equal for repeated rows, different for other texts under one doc_id."""
    of = (F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    return F.xxhash64(*of), F.xxhash64(F.lit(1), *of)


def remainder(mod: int):
    """crc32 of the decimal doc_id, modulo mod (null for a null doc_id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(mod)

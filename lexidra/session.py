"""Session-level helpers: shared storage, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is handed to every task only when its rows, counted, fit in this many bytes.
SHIP_BYTES = 64 * 1024 * 1024
# An input of at least so many partitions is left where it is, whatever the number of cores.
FEW_PARTITIONS = 16
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder: on a
    cluster a folder of one machine would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lexidra-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    named = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted when each write ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, in compressed columns.

    Later steps then see the same rows whatever executors are lost, which matters where rows
    were numbered, and nothing behind the table is computed again.  For rows that are many or
    wide: a checkpoint writes them uncompressed and leaves the shuffles behind it on the disks.
    """
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing unfinished reads any more."""
    for df in tables:
        folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
        spark = df.sparkSession
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that arrives in a handful of partitions over the cores.

    A few small files would otherwise be expanded by a few tasks.  Only inputs of fewer than
    ``FEW_PARTITIONS`` splits, so of bounded size, are ever shuffled for that.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, FEW_PARTITIONS)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def arrow_if_small(df: DataFrame, row_bytes: int, max_bytes: int = SHIP_BYTES) -> pa.Table | None:
    """``df`` as an Arrow table when at most ``max_bytes // row_bytes`` rows exist, otherwise None.

    The rows are counted first, on the executors and no further than one row above the bound.
    """
    bound = max(1, max_bytes // max(1, row_bytes))
    counted = df.select(F.lit(1).alias("one")).limit(bound + 1).count()
    return df.toArrow() if counted <= bound else None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the file system that owns the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path`` (empty when the path does not exist)."""
    if not path_exists(spark, path):
        return []
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in fs.listStatus(target))

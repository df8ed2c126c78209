"""Shared plumbing of the training-data operators: tables, shared storage, plan sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, even if only the driver's
    sys.path names that folder (a packaged or installed library is found first)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.  Only where that is
    unset (a single machine, as in tests) a temporary folder takes its place."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return at or sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends there and an
    executor's loss costs nothing that is done.  What this made before is returned as it is."""
    if hasattr(df, "_written_at"):
        return df
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int = 16 << 20):
    """Arrow batches of at most so many rows and about so many bytes for what runs inside: rows of tens
    of kilobytes by the ten thousand would fill a worker."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def give_back() -> None:
    """What a Python worker has freed goes back to the system.  Workers live on from stage to stage: else what the
    allocators keep of one stage adds to what the next one takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written(), and the shuffle files that made them; nothing may read them later."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's JVM collects their handles: ask it to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size (file sizes for a scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(df: DataFrame, mb: int = 16) -> int:
    """Partitions for a shuffle of df: the session's number, or more where the input asks for it."""
    size = plan_bytes(df)
    known = size if size < 1 << 60 else 0  # rows from outside of files have no estimate
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // (mb << 20)))


#: A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count (that stops beyond `most`) proves it small; else df
    as it is, for a shuffled join.  Use it on narrow aggregates that were written before."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

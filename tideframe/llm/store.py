"""Durable intermediate tables.

Lineage is cut by writing Parquet into the folder that the session names in ``spark.checkpoint.dir``: every executor
and the driver share it, so a lost executor costs a task and not the job.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for a local master that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tideframe-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of ``rows``, unless the session asks for fewer.

    A batch is held by the JVM, outside its heap, and by the worker; the default of 10,000 rows of text is tens of MB in
    each of them for every task. The setting holds for the session, as results are evaluated after an operator returns.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def one_row_a_batch(spark: SparkSession):
    """Within this block what is evaluated hands rows to Python one at a time: rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def task_count(spark: SparkSession, size: int, most: int = 32_000_000) -> int:
    """Partitions for a shuffle of ``size`` bytes: the session's number, or more if they would hold over ``most`` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


@contextlib.contextmanager
def _shuffle_files_freed(spark: SparkSession):
    """Within this block a finished query's shuffle files go at once instead of waiting for a driver's collection."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideframe/{name}-{uuid.uuid4().hex}"
    with _shuffle_files_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    _written.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a durable table that nothing will read again."""
    path = getattr(df, "_durable_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the durable tables that are written within this block when it ends, but for those put in the list it gives.

    For callers that write an operator's result before they leave: results are evaluated late, and rest on those tables.
    """
    before, kept = set(_written), []
    yield kept
    for path in sorted(_written - before - {df._durable_path for df in kept}):
        _delete(spark, path)

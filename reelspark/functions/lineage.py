"""Cutting lineage and finding scratch space on shared storage."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a local master gets a folder of its own; a cluster is
    refused, since a machine-local folder is lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelspark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there.

    The copy survives the loss of any executor. Unlike a checkpointed frame it
    has known sizes, so small ones are broadcast without waiting for a shuffle.
    """
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def allow_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits checkpoint their intermediate factors."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


class _Scopes(threading.local):
    """Paths to delete at the end of each open ``scratch_scope`` of the thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It lasts as long as the innermost open
    ``scratch_scope``, or until the folder is cleared."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """A block at whose end the tables that ``cut`` wrote inside it are deleted.

    Results that still read them must be written before the block ends.
    """
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.pop()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


def kept(spark: SparkSession, make: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """What ``make`` returns, written to the shared folder (to ``path`` if it is given); all
    that ``cut`` wrote on the way there is deleted."""
    path = path or scratch(spark, "kept")
    with scratch_scope(spark):
        made = make()
        made.write.parquet(path)
        schema = made.schema
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and cached blocks that nothing refers to any more.

    It learns of them when the driver collects garbage, which without this may
    be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def released(spark: SparkSession):
    """A block at whose end the data that fits cached inside it are released.

    For a driver that does one thing at a time: what other threads cache
    meanwhile is released too, and computed again where it is needed.
    """
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    try:
        yield
    finally:
        for number, rdd in dict(spark.sparkContext._jsc.getPersistentRDDs()).items():
            if number not in before:
                rdd.unpersist(False)

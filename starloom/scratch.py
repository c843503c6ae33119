"""Intermediate tables, written to the shared folder the cluster names in ``spark.checkpoint.dir``.

A written table survives the loss of executors, is read back with true size statistics (so the
planner, not a hint, decides whether it is small enough to broadcast) and never gets recomputed.
"""

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_to_drop: ContextVar[list[str] | None] = ContextVar("_to_drop", default=None)


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    """Only for a session whose executors all live on this machine."""
    return tempfile.mkdtemp(prefix="starloom-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used before; all paths of an application share a folder, to be removed after it."""
    application = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/starloom/{application}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once and read back."""
    path = scratch_path(df.sparkSession, label)
    if (paths := _to_drop.get()) is not None:
        paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Around steps whose result is written: what they staged is deleted at their end, and shuffle files after each job.

    Without it shuffle files stay until the driver's garbage collector happens to find that nothing refers to them. A
    table that was staged inside must not be read outside.
    """
    before, paths = spark.conf.get(SHUFFLE_CLEANUP), []
    outer = _to_drop.set(paths)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
        _to_drop.reset(outer)
        for path in paths:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, on whichever file system it is."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application: call it when nothing that was read from them is needed."""
    drop(spark, f"{scratch_root(spark)}/starloom/{spark.sparkContext.applicationId}")

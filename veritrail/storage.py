"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
#: Tables written inside the innermost ``stage_tables`` of this thread or task.
_scope: ContextVar[list[str] | None] = ContextVar("stage_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a local master, and an error
    on a cluster, whose executors don't share the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="veritrail-")
    return _fallback[app]


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    """A path of its own in the shared folder, which goes when the innermost ``stage_tables`` ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if (written := _scope.get()) is not None:
        written.append(path)
    return path


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as Parquet, pressed harder than by Spark's default: these tables are read soon, and their disk counts."""
    df.write.parquet(path, partitionBy=list(partition_by) or None, compression="zstd")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which survives lost executors."""
    path = new_path(df.sparkSession)
    write(df, path, *partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write inside. What they return must have been written elsewhere by then."""
    written: list[str] = []
    before = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in written:
            delete(spark, path)

"""Locations on the filesystem the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _filesystem(spark, path)
    return filesystem.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    filesystem, target = _filesystem(spark, path)
    return filesystem.delete(target, True)


def move_path(spark: SparkSession, path: str, target: str) -> None:
    """Rename a file or folder; ``target``'s parent exists, ``target`` does not."""
    filesystem, source = _filesystem(spark, path)
    if not filesystem.rename(source, _filesystem(spark, target)[1]):
        raise OSError(f"cannot move {path} to {target}")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor sees,
    or below the session's warehouse, where tables are shared, if that is not set.  A warehouse
    on one machine's own disk is refused unless all of Spark runs on that machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        here = spark.sparkContext.master.startswith("local")
        if not here and _filesystem(spark, warehouse)[0].getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse.rstrip('/')}/scratch"
    return f"{shared.rstrip('/')}/oreline-{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[str] = ContextVar("scratch_scope", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{_SCOPE.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes when the scope ends: for steps whose result is written
    elsewhere before that."""
    name = f"{_SCOPE.get()}scope-{uuid.uuid4().hex}/"
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete_path(spark, f"{scratch_root(spark)}/{name}")
        free_shuffles(spark)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote below ``scratch_root``."""
    return delete_path(spark, scratch_root(spark))


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs whose results were stored.

    It does so when their plans are garbage in the driver, which on large executors and a small
    driver may not be before the disks are full; this collects the driver's garbage now."""
    spark._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as parquet to the shared scratch folder and read back (runs the write).

    For a result that several later plans read: computed once, it survives lost
    executors, and each reader scans just the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

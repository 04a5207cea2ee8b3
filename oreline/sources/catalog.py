"""Named tables in Spark's session catalog, kept as parquet on shared storage.

Tables are created once with declared columns and then only inserted into, so a row that does
not fit the declaration fails the insert instead of spoiling the table.

A table may be bucketed: its files are then dealt by a hash of some columns, and joins and
aggregations on these read it without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    root: str,
    partitions: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> None:
    """``name`` is ``schema.table``; both come into being if they do not exist.

    Tables that are to meet without a shuffle need the same ``bucket_by`` and ``buckets``."""
    layer, table = name.split(".")
    root = root.rstrip("/")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{layer}` LOCATION '{root}/{layer}'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
    if bucket_by and buckets:
        keys = ", ".join(f"`{c}`" for c in bucket_by)
        by += f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{layer}`.`{table}` ({columns}) USING parquet {by}"
        f" LOCATION '{root}/{layer}/{table}'"
    )


def insert(rows: DataFrame, name: str) -> None:
    """Append ``rows`` by column name; a missing column or one that cannot be stored as its
    declared type raises before anything is written.

    Rows of a bucketed table are dealt by its buckets first, so that a bucket gets few files.
    A rebalance: a bucket with much of the rows is written by several tasks."""
    count, keys = bucketing(rows.sparkSession, name)
    if count:
        rows = rows.hint("rebalance", count, *[F.col(f"`{c}`") for c in keys])
    rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name)


def bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    """Number and columns of a table's buckets; 0 and none if it has none."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    keys = told.get("Bucket Columns", "[]")[1:-1]
    return int(told.get("Num Buckets", 0)), [k.strip().strip("`") for k in keys.split(",") if k]


def replace_partitions(rows: DataFrame, name: str) -> None:
    """Make ``rows`` the whole content of the partitions they belong to; others stay.

    ``rows`` may read the table: the new files take the old ones' place when all are written.
    """
    spark = rows.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)

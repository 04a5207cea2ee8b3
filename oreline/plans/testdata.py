"""The test tables in the roles of the retail entities, and the batches derived from them.

customers <- customer, products <- part, orders <- orders, order_items <- lineitem.
Channel is the order priority, status the order status (``F`` counts as completed), city
the nation key, category the part type.  Dates the source lacks derive from the keys.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.operators.absent import join_afresh
from oreline.sources.batches import batch_file
from oreline.sources.paths import move_path, path_exists, scratch_path

COMPLETED = "F"
SECOND_BATCH_FROM = "1998-07-01"
RUN_DATE = date(2001, 8, 15)
NOW = datetime(2001, 8, 15)
COMPACTED = datetime(2001, 9, 1)
# Every commit is more than a month old.
LATER = datetime(2001, 10, 15)
EFFECTIVE = date(2026, 12, 31)

# The customer segments of the test data, alphabetically.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# The order priorities of the test data.
CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


# Columns and types of the test tables in use.
SOURCES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Declared rather than inferred: no job to read footers before the query itself."""
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 of the customers."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id",
        "c_name AS name",
        "CAST(c_nationkey AS STRING) AS city",
        "c_mktsegment AS segment",
        "date_add(DATE '1995-01-01', CAST(c_custkey % 1000 AS INT)) AS signup_date",
    )


def customers_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 2: every tenth customer moves to the next segment, every seventh to the next
    city, and the untracked sign-up date of all of them shifts by a day."""
    moves = " ".join(
        f"WHEN '{old}' THEN '{new}'" for old, new in zip(SEGMENTS, SEGMENTS[1:] + SEGMENTS[:1])
    )
    return customers(spark, sf_dir).selectExpr(
        "customer_id",
        "name",
        "IF(customer_id % 7 = 0, CAST((CAST(city AS INT) + 1) % 25 AS STRING), city) AS city",
        f"IF(customer_id % 10 = 0, CASE segment {moves} END, segment) AS segment",
        "date_add(signup_date, 1) AS signup_date",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "concat('SKU-', p_partkey) AS sku",
        "p_name AS name",
        "p_type AS category",
        "p_brand AS subcategory",
        "CAST(p_retailprice AS DECIMAL(14,2)) AS unit_price",
        "CAST(p_retailprice AS DECIMAL(14,2)) AS cost",
        "date_add(DATE '1990-01-01', CAST(p_partkey % 1000 AS INT)) AS launch_date",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderdate AS order_date",
        "o_orderpriority AS channel",
        "o_orderstatus AS status",
    )


_EARLY = f"order_date < TIMESTAMP_NTZ '{SECOND_BATCH_FROM}'"
_IN_BATCH = {1: _EARLY, 2: f"NOT {_EARLY} OR order_id % 50 = 0"}
_LINE = (
    "l_orderkey AS order_id",
    "l_partkey AS product_id",
    "CAST(l_quantity AS INT) AS quantity",
    "CAST(l_extendedprice AS DECIMAL(14,2)) AS unit_price_at_sale",
    "CAST(l_discount AS DECIMAL(4,2)) AS discount_pct",
)


def order_batch(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Batch 1 ends before the cut-off date; batch 2 is the rest, and delivers every
    fiftieth order of batch 1 again."""
    return orders(spark, sf_dir).where(_IN_BATCH[number])


def order_items(
    spark: SparkSession, sf_dir: str, shipped_before: str | None = None, shipped_from: str | None = None
) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if shipped_from is not None:
        lines = lines.where(f"l_shipdate >= TIMESTAMP_NTZ '{shipped_from}'")
    if shipped_before is not None:
        lines = lines.where(f"l_shipdate < TIMESTAMP_NTZ '{shipped_before}'")
    return lines.selectExpr("concat_ws('-', l_orderkey, l_linenumber) AS order_item_id", *_LINE)


def delivered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each batch's orders, with the number of their ``batch``.

    Lines are shuffled once for both batches, and their ids are made after that."""
    arrivals = orders(spark, sf_dir).groupBy("order_id").agg(
        *[F.expr(f"coalesce(bool_or({chosen}), false)").alias(f"in_{n}") for n, chosen in _IN_BATCH.items()]
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber", *_LINE)
    numbers = ", ".join(f"IF(in_{n}, {n}, NULL)" for n in _IN_BATCH)
    return join_afresh(lines, arrivals.where("in_1 OR in_2"), ["order_id"], "inner", step=1).selectExpr(
        "concat_ws('-', order_id, l_linenumber) AS order_item_id",
        "order_id",
        "product_id",
        "quantity",
        "unit_price_at_sale",
        "discount_pct",
        f"explode(array_compact(array({numbers}))) AS batch",
    )


def versioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits: the two batches without re-delivery, then a removal of every
    hundredth order."""
    return orders(spark, sf_dir).selectExpr(
        "*",
        f"IF({_EARLY}, 1L, 2L) AS added_snapshot",
        "IF(order_id % 100 = 0, 3L, NULL) AS removed_snapshot",
    )


def products_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 2: all products again, at new prices."""
    return products(spark, sf_dir).withColumns(
        {c: (F.col(c) + 1).cast("decimal(14,2)") for c in ("unit_price", "cost")}
    )


def write_batches(spark: SparkSession, sf_dir: str) -> list[str]:
    """Both batches as directories of four headed CSV files, below the scratch folder; each
    has the lines of its orders."""
    root = scratch_path(spark, "raw")
    directories = []
    for number in (1, 2):
        arriving = order_batch(spark, sf_dir, number)
        entities = {
            "customers": (customers, customers_second)[number - 1](spark, sf_dir),
            "products": (products, products_second)[number - 1](spark, sf_dir),
            "orders": arriving.withColumn("status", F.when(F.col("status") == COMPLETED, "completed").otherwise("refunded")),
        }
        directories.append(f"{root}/batch{number}")
        for entity, rows in entities.items():
            rows.write.option("header", True).csv(batch_file(directories[-1], entity))
    # Both batches' lines in one job, as folders that then go where each batch has its own.
    lines = delivered_items(spark, sf_dir)
    lines.write.option("header", True).partitionBy("batch").csv(f"{root}/order_items")
    for number, directory in enumerate(directories, 1):
        written, path = f"{root}/order_items/batch={number}", batch_file(directory, "order_items")
        if path_exists(spark, written):
            move_path(spark, written, path)
        else:  # no lines in it
            lines.where("false").drop("batch").write.option("header", True).csv(path)
    return directories


def stored_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The versioned orders, in directories by the commit that added them, and the log.

    Written anew on every call, from the orders as they are then."""
    rows, log = versioned_orders(spark, sf_dir), order_snapshots(spark, sf_dir)
    path = scratch_path(spark, "history")
    rows.write.partitionBy("added_snapshot").parquet(f"{path}/rows")
    log.coalesce(1).write.parquet(f"{path}/log")
    versioned = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)
    return versioned, spark.read.schema(log.schema).parquet(f"{path}/log")


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of ``versioned_orders``: an append is dated by its newest order, the
    removal one day after the newest of all."""
    rows = versioned_orders(spark, sf_dir)
    newest = F.max("order_date")
    appends = (
        rows.groupBy(F.col("added_snapshot").alias("snapshot_id"))
        .agg(newest.alias("committed_at"))
        .withColumn("operation", F.lit("append"))
    )
    removal = rows.agg(
        F.max("removed_snapshot").alias("snapshot_id"),
        (newest + F.expr("INTERVAL 1 DAY")).alias("committed_at"),
    ).withColumn("operation", F.lit("delete"))
    return appends.unionByName(removal)

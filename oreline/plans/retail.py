"""The retail pipeline: raw batches to bronze, silver and gold tables, then the gate.

Tables live in the session catalog as ``bronze.orders``, ``silver.fact_sales`` and so on; a
``prefix`` sets several warehouses of one session apart (``test_bronze.orders``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from oreline.operators import dimensions, facts, marts, quality
from oreline.plans.retail_suite import adapted
from oreline.schemas import RAW, TABLES
from oreline.sources.batches import batch_number, counted, read_batch
from oreline.sources.catalog import bucketing, create_table, insert, replace_partitions
from oreline.sources.paths import stored


# Tables that meet by order.
BUCKETED = ("bronze.orders", "bronze.order_items", "silver.fact_sales")


def create_tables(
    spark: SparkSession, root: str, prefix: str = "", buckets: int = 0, by_month: bool = False
) -> None:
    """Bronze tables hold the raw columns plus the batch they came in, which they are
    partitioned by: work on one batch opens no file of another.  The Type 2 dimension is
    partitioned so that closed history is neither read nor written again.

    With ``buckets`` orders, their items and the fact are bucketed by order, so that new sales
    are found without a shuffle of any.  With ``by_month`` the fact has a last column
    ``sale_month`` that it is partitioned by, and the daily mart reads only months it lacks
    something of.  Both multiply the number of files: choose them for large tables."""
    batch_id = T.StructField("batch_id", T.IntegerType())
    for name, schema in TABLES.items():
        if name.startswith("bronze."):
            schema, by = T.StructType(schema.fields + [batch_id]), ("batch_id",)
        else:
            by = ("is_current", "valid_to") if name == "silver.dim_customers" else ()
        if by_month and name == "silver.fact_sales":
            month = T.StructField("sale_month", T.DateType())
            schema, by = T.StructType(schema.fields + [month]), ("sale_month",)
        keys = ("order_id",) if name in BUCKETED else ()
        create_table(spark, prefix + name, schema, root, by, keys, buckets)


def load_bronze(
    spark: SparkSession, batch_dir: str, prefix: str = "", skip_loaded: bool = False
) -> DataFrame:
    """Append the four files of a batch and return its stored rows per entity.

    Loading a batch again appends it again; ``skip_loaded`` leaves entities alone that
    already hold it.  Rows are counted as they are written; only what a table held of the batch
    before is counted by reading (its footers).
    """
    number = batch_number(batch_dir)
    counts = []
    for entity in RAW:
        name = f"{prefix}bronze.{entity}"
        batch, written = read_batch(spark, batch_dir, entity), 0
        before = spark.table(name).where(F.col("batch_id") == number).count()
        if not (skip_loaded and before):
            batch, written = counted(batch)
            insert(batch, name)
            written = written()
        counts.append((entity, number, before + written))
    return spark.createDataFrame(counts, "entity STRING, batch_id INT, row_count BIGINT")


def build_silver(
    spark: SparkSession, effective_date: date, batch: int | None = None, prefix: str = ""
) -> DataFrame:
    """Bring dimensions and fact up to date: products first, the fact needs their cost.
    Returns the rows added to the fact, which ``build_gold`` can go by.

    ``batch`` limits the work to one batch.  Without it all of bronze is read and the
    newest batch wins where a customer or product occurs in several.
    """

    def bronze(entity: str) -> DataFrame:
        rows = spark.table(f"{prefix}bronze.{entity}")
        return rows if batch is None else rows.where(F.col("batch_id") == batch)

    def silver(table: str) -> DataFrame:
        return spark.table(f"{prefix}silver.{table}")

    products = dimensions.insert_new(silver("dim_products"), bronze("products"), order_by=["batch_id"])
    insert(products, f"{prefix}silver.dim_products")

    dim = silver("dim_customers")
    touched = dimensions.scd2_touched(dim, bronze("customers"), effective_date, order_by=["batch_id"])
    touched = stored(touched, "touched")
    closed = touched.where(~F.col("is_current")).select("customer_id")
    untouched = dimensions.current(dim).join(closed, "customer_id", "left_anti")
    # Rows closed at this date before share a partition with those closed now.
    same_day = dim.where(~F.col("is_current") & (F.col("valid_to") == F.lit(effective_date)))
    rows = untouched.unionByName(touched).unionByName(same_day)
    replace_partitions(rows, f"{prefix}silver.dim_customers")

    fact, name = silver("fact_sales"), f"{prefix}silver.fact_sales"
    find = facts.new_sales_colocated if bucketing(spark, name)[0] else facts.new_sales
    sales = find(fact, bronze("orders"), bronze("order_items"), silver("dim_products"))
    if "sale_month" in fact.columns:
        sales = sales.withColumn("sale_month", marts.sale_month("order_date"))
    sales = stored(sales, "sales")
    insert(sales, name)
    return sales


def build_gold(spark: SparkSession, prefix: str = "", added: DataFrame | None = None) -> None:
    """Add the mart rows whose grain is new.

    ``added``, all rows the fact got since the last call, spares a fact partitioned by month
    the reading of months that the daily mart lacks nothing of."""
    fact = spark.table(f"{prefix}silver.fact_sales")
    daily, products = f"{prefix}gold.daily_sales", spark.table(f"{prefix}silver.dim_products")
    if added is not None and "sale_month" in fact.columns:
        insert(marts.new_daily_sales_since(spark.table(daily), fact, added, products), daily)
    else:
        insert(marts.new_daily_sales(spark.table(daily), fact, products), daily)
    segments = f"{prefix}gold.customer_segments"
    insert(
        marts.new_customer_segments(
            spark.table(segments), fact, spark.table(f"{prefix}silver.dim_customers")
        ),
        segments,
    )


def check_quality(
    spark: SparkSession, run_date: date, suite: dict | None = None, prefix: str = ""
) -> DataFrame:
    """Results of ``suite`` (the retail suite) over the catalog's tables."""
    suite = suite or adapted({name: prefix + name for name in TABLES}, {})
    return quality.run_suite(spark, {}, suite, run_date)

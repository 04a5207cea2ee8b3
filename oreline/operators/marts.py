"""Gold marts.  Aggregates of the sales fact; stored grains are never refreshed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions import half_up_ratio
from oreline.operators.absent import absent_from, join_afresh
from oreline.operators.dimensions import current
from oreline.sources.paths import stored
from oreline.schemas import CUSTOMER_SEGMENTS, DAILY_SALES, conform

DAILY_GRAIN = ("sale_date", "channel", "category")
SEGMENT_GRAIN = ("segment",)


def daily_sales(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Orders, units, sales, cost and margin per day, channel and category.

    The distinct count makes Spark aggregate per grain *and order* first, partially
    in the map tasks, so neither a busy day nor a huge order gathers in one task.
    """
    gross, cost = F.sum("gross_amount"), F.sum("cost_amount")
    # A fact built just before is still dealt out by product: without fresh shuffles a
    # product with much of the sales would be one task.
    sold = join_afresh(fact, products.select("product_id", "category"), ["product_id"], "inner", step=3)
    mart = sold.groupBy(F.to_date("order_date").alias("sale_date"), "channel", "category").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("units"),
        F.round(gross, 2).alias("gross_amount"),
        F.round(gross, 2).alias("net_amount"),
        F.round(cost, 2).alias("cost_amount"),
        F.round(gross - cost, 2).alias("margin_amount"),
        half_up_ratio(gross - cost, gross, 4).alias("margin_pct"),
    )
    return conform(mart, DAILY_SALES)


def new_daily_sales(mart: DataFrame, fact: DataFrame, products: DataFrame) -> DataFrame:
    """Daily rows whose grain ``mart`` lacks."""
    return absent_from(mart, daily_sales(fact, products), DAILY_GRAIN)


def sale_month(moment: str) -> Column:
    """First day of the month, to partition by; rows without a time share the first of all."""
    return F.coalesce(F.trunc(moment, "month"), F.lit("0001-01-01").cast("date")).alias("sale_month")


def new_daily_sales_since(
    mart: DataFrame, fact: DataFrame, added: DataFrame, products: DataFrame
) -> DataFrame:
    """Daily rows whose grain ``mart`` lacks, reading only the months that have some.

    ``added`` are the rows of ``fact`` since ``mart`` was last brought up to date: a grain that
    the mart lacks occurs in them.  ``fact`` (of which they are part) has a column
    ``sale_month`` that it is partitioned by; so may ``mart``, whose other months are then not
    read either.  A day that is in the mart under another channel or category counts, and
    stored grains are not refreshed.  A NULL in the grain counts as absent whenever ``added``
    brings it.

    The lacking grains, at most as many as ``added`` has rows, are stored first (a job).  Of
    them only the distinct months are broadcast, never more than 12 per year of the calendar.
    """
    sold = added.join(products.select("product_id", "category"), "product_id")
    grains = sold.select(
        F.to_date("order_date").alias("sale_date"), "channel", "category", sale_month("order_date")
    ).distinct()
    if "sale_month" in mart.columns:
        mart = _of_months(mart, grains)
    lacking = stored(absent_from(mart, grains, DAILY_GRAIN), "lacking")
    daily = daily_sales(_of_months(fact, lacking), products)
    same = [daily[c].eqNullSafe(lacking[c]) for c in DAILY_GRAIN]
    return daily.join(lacking, reduce(Column.__and__, same), "left_semi")


def _of_months(rows: DataFrame, grains: DataFrame) -> DataFrame:
    """``rows`` of the months in ``grains``; partitions of other months are not opened.

    The count makes the months a filtered relation, which Spark asks for before it prunes."""
    months = grains.groupBy("sale_month").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return rows.join(F.broadcast(months), "sale_month", "left_semi")


def customer_segments(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers, sales and average order value per segment of the current dimension.

    Two distinct counts make Spark triple its input, so the lines are reduced to one
    row per customer and order before they meet the dimension.
    """
    per_order = fact.groupBy("customer_id", "order_id").agg(F.sum("gross_amount").alias("gross"))
    placed = per_order.join(
        current(customers).select("customer_id", "segment"), "customer_id", "inner"
    )
    # Sum of sums, narrowed to the type of a plain sum so the division keeps its scale.
    gross = F.sum("gross").cast("decimal(24,2)")
    mart = placed.groupBy("segment").agg(
        F.count_distinct("customer_id").alias("customers"),
        F.round(gross, 2).alias("total_gross"),
        half_up_ratio(gross, F.count_distinct("order_id"), 2).alias("avg_order_value"),
    )
    return conform(mart, CUSTOMER_SEGMENTS)


def new_customer_segments(mart: DataFrame, fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Segment rows whose segment ``mart`` lacks."""
    return absent_from(mart, customer_segments(fact, customers), SEGMENT_GRAIN)

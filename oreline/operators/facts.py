"""Sales fact: one row per line of a completed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oreline.functions import line_cost, line_gross
from oreline.operators.absent import join_afresh, keys_shared
from oreline.schemas import FACT_SALES, conform

# Fixed value: status of an order that counts as sold.
COMPLETED = "completed"

# Orders of a batch up to which their ids select buckets and row groups of the stored tables.
FEW_ORDERS = 1000

_HEADER = ("order_id", "order_date", "channel", "customer_id")
_LINE = ("order_id", "product_id", "quantity", "unit_price_at_sale", "discount_pct")


def _completed(orders: DataFrame, status: str) -> DataFrame:
    return orders.where(F.col("status") == status).select(*_HEADER)


def _priced(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Add the product's cost and the two amounts; lines of unknown products drop out."""
    costed = lines.join(products.select("product_id", "cost"), "product_id", "inner")
    return conform(
        costed.withColumns(
            {
                "gross_amount": line_gross(
                    F.col("quantity"), F.col("unit_price_at_sale"), F.col("discount_pct")
                ),
                "cost_amount": line_cost(F.col("quantity"), F.col("cost")),
            }
        ),
        FACT_SALES,
    )


def build_fact(
    orders: DataFrame, items: DataFrame, products: DataFrame, status: str = COMPLETED
) -> DataFrame:
    """Completed orders with their items and product cost.

    Both joins read plain shuffles (or broadcast a small dimension), so adaptive
    execution can split an order or product that holds much of the data.
    """
    lines = _completed(orders, status).join(items.select(*_LINE), "order_id", "inner")
    return _priced(lines, products)


def new_sales(
    fact: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    status: str = COMPLETED,
) -> DataFrame:
    """Fact rows of orders that ``fact`` does not hold at all.

    Deduplication is per order and only against the stored fact: an order repeated
    within ``orders`` yields its lines repeatedly, and lines that arrive later for an
    order already loaded are left out.
    """
    sold = _completed(orders, status)
    loaded = keys_shared(fact, sold, ["order_id"])
    pending = join_afresh(sold, loaded, ["order_id"], "left_anti", step=1)
    lines = join_afresh(pending, items.select(*_LINE), ["order_id"], "inner", step=2)
    return _priced(lines, products)


def new_sales_colocated(
    fact: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    status: str = COMPLETED,
) -> DataFrame:
    """``new_sales`` where ``fact`` and ``items`` are tables bucketed by ``order_id``.

    Both are read where they lie: their keys and lines meet the batch without a shuffle of
    either, whatever their size; only ``orders`` is shuffled, if it is not bucketed as well.
    The ids of a batch of at most ``FEW_ORDERS`` orders (found by a job that fetches one more
    than that) go to the scans, which then open the buckets that may hold them and no other.

    A bucket is one task, also where one order fills it: such an order's lines stream through a
    merge join there.  Where that is too slow, keep the tables without buckets and use
    ``new_sales``, which splits hot orders and pays with a shuffle.
    """
    sold = _completed(orders, status)
    ids = [r["order_id"] for r in sold.select("order_id").distinct().limit(FEW_ORDERS + 1).collect()]
    lines = items.select(*_LINE)
    if len(ids) <= FEW_ORDERS:
        wanted = F.col("order_id").isin([i for i in ids if i is not None])
        fact, lines = fact.where(wanted), lines.where(wanted)
    loaded = fact.select("order_id").distinct()
    pending = sold.join(loaded, "order_id", "left_anti")
    return _priced(pending.join(lines, "order_id", "inner"), products)

"""Fact lines, their order-level deduplication, and marts that never refresh a grain."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F, types as T

from oreline.operators import facts, marts
from oreline.plans import queries, testdata as td
from oreline.schemas import DIM_CUSTOMERS, FACT_SALES, RAW
from oreline.sources import batches

SF = "/root/testdata/sf0.001"
NOON = datetime(2026, 3, 1, 12)


def orders(spark, *rows):
    return spark.createDataFrame([(o, c, NOON, "web", status) for o, c, status in rows], RAW["orders"])


def items(spark, *rows):
    return spark.createDataFrame(
        [(f"i{n}", o, p, q, D(price), disc) for n, (o, p, q, price, disc) in enumerate(rows)],
        RAW["order_items"],
    )


def products(spark, *rows):
    return spark.createDataFrame(
        [(p, "s", "n", cat, "sub", D(cost), D(cost), date(2026, 1, 1)) for p, cat, cost in rows],
        RAW["products"],
    )


def small(spark):
    return (
        orders(spark, (1, 7, "completed"), (2, 8, "cancelled"), (3, 7, "completed"), (None, 9, "completed")),
        items(spark, (1, 5, 2, "10.00", 0.25), (1, 6, 1, "3.33", 0.0), (2, 5, 1, "1.00", 0.0), (3, 99, 1, "1.00", 0.0)),
        products(spark, (5, "toys", "4.00"), (6, "books", "1.11")),
    )


def test_fact_lines_of_completed_orders(spark):
    fact = facts.build_fact(*small(spark))
    assert [f.dataType for f in fact.schema] == [f.dataType for f in FACT_SALES]
    got = sorted((r.order_id, r.product_id, r.gross_amount, r.cost_amount) for r in fact.collect())
    # order 3 sells an unknown product
    assert got == [(1, 5, D("15.00"), D("8.00")), (1, 6, D("3.33"), D("1.11"))]


def test_only_orders_the_fact_lacks_are_added(spark):
    o, i, p = small(spark)
    fact = facts.build_fact(o, i, p)
    late = i.unionByName(items(spark, (1, 6, 9, "1.00", 0.0), (4, 5, 1, "2.00", 0.0)))
    batch = o.unionByName(orders(spark, (4, 7, "completed")))
    added = facts.new_sales(fact, batch, late, p)
    # the late line of order 1 is left out: the order is already loaded
    assert [(r.order_id, r.quantity) for r in added.collect()] == [(4, 1)]
    assert facts.new_sales(fact.unionByName(added), batch, late, p).isEmpty()


def test_order_repeated_within_a_load_repeats_its_lines(spark):
    o, i, p = small(spark)
    empty = spark.createDataFrame([], FACT_SALES)
    assert facts.new_sales(empty, o.unionByName(o), i, p).count() == 4


def test_daily_sales_amounts_and_zero_gross(spark):
    o, i, p = small(spark)
    free = items(spark, (1, 6, 5, "0.00", 0.0)).unionByName(i.where("product_id = 5"))
    mart = {r.category: r for r in marts.daily_sales(facts.build_fact(o, free, p), p).collect()}
    toys = mart["toys"]
    assert (toys.sale_date, toys.channel, toys.orders, toys.units) == (date(2026, 3, 1), "web", 1, 2)
    assert (toys.gross_amount, toys.net_amount, toys.cost_amount) == (D("15.00"), D("15.00"), D("8.00"))
    assert (toys.margin_amount, toys.margin_pct) == (D("7.00"), 0.4667)
    assert mart["books"].margin_pct is None and mart["books"].margin_amount == D("-5.55")


def test_existing_daily_grain_is_never_refreshed(spark):
    o, i, p = small(spark)
    mart = marts.daily_sales(facts.build_fact(o, i.where("product_id = 5"), p), p)
    fact = facts.build_fact(o, i.unionByName(items(spark, (1, 5, 100, "1.00", 0.0))), p)
    assert [r.category for r in marts.new_daily_sales(mart, fact, p).collect()] == ["books"]


def test_null_grain_counts_as_absent_every_time(spark):
    o, i, p = small(spark)
    fact = facts.build_fact(o.withColumn("channel", F.lit(None).cast("string")), i, p)
    mart = marts.daily_sales(fact, p)
    assert marts.new_daily_sales(mart, fact, p).count() == 2


def dim(spark, *rows):
    return spark.createDataFrame(
        [(c, "n", "x", seg, None, None, None, cur, None) for c, seg, cur in rows], DIM_CUSTOMERS
    )


def test_segments_use_current_rows_and_count_distinct(spark):
    fact = spark.createDataFrame(
        [
            (o, NOON, "web", c, 5, 1, D("1"), 0.0, D(gross), D("1"))
            for o, c, gross in [(1, 7, "10.00"), (1, 7, "0.01"), (2, 7, "5.00"), (2, 8, "1.00"), (3, 9, "2.00")]
        ],
        FACT_SALES,
    )
    customers = dim(spark, (7, "old", False), (7, "pro", True), (8, "pro", True), (9, "home", True))
    got = {r.segment: r for r in marts.customer_segments(fact, customers).collect()}
    assert got.keys() == {"pro", "home"}
    # order 2 appears under two customers of the segment and counts once
    assert (got["pro"].customers, got["pro"].total_gross, got["pro"].avg_order_value) == (2, D("16.01"), D("8.01"))
    stale = marts.customer_segments(fact.limit(1), customers)
    assert [r.segment for r in marts.new_customer_segments(stale, fact, customers).collect()] == ["home"]


def test_incremental_fact_reads_lines_once_beside_the_stored_fact(spark):
    found = queries.fact_incremental(spark, SF)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in text and "& 1)" in text  # one bit, not a whole hash, is shuffled
    assert sum(f.endswith("lineitem.parquet") for f in found.inputFiles()) == 1
    assert len([line for line in text.splitlines() if "l_orderkey" in line and "Relation" in line]) == 1


def test_lines_delivered_with_their_orders(spark, tmp_path):
    """By one shuffle of the lines for both batches, also with orders repeated or without key or date."""
    early, late = datetime(1998, 1, 1), datetime(1999, 1, 1)
    orders = [(1, early), (1, early), (2, late), (3, early), (3, late), (50, early), (None, late), (4, None), (100, None)]
    lines = [(k, n) for k in (1, 2, 3, 4, 50, 100, 999, None) for n in (1, 2)] + [(1, 2)]
    kinds = {name: td.SOURCES[name] for name in ("orders", "lineitem")}
    for name, rows, keys in (
        ("orders", orders, ["o_orderkey", "o_orderdate"]), ("lineitem", lines, ["l_orderkey", "l_linenumber"])
    ):
        schema = T.StructType.fromDDL(kinds[name])
        full = [tuple(dict(zip(keys, row)).get(f.name) for f in schema) for row in rows]
        spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = td.delivered_items(spark, str(tmp_path))
    for number in (1, 2):
        arriving = td.order_batch(spark, str(tmp_path), number).select("order_id")
        items = td.order_items(spark, str(tmp_path))
        wanted = items.join(arriving, "order_id", "left_semi").select(*items.columns)
        got = found.where(F.col("batch") == number).drop("batch")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, wanted.collect()))


def test_batch_without_lines_is_an_empty_file(spark, tmp_path):
    for name in ("customer", "part", "orders", "lineitem"):
        td.table(spark, SF, name).limit(0 if name == "lineitem" else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    for directory in td.write_batches(spark, str(tmp_path)):
        assert batches.read_batch(spark, directory, "order_items").isEmpty()
        assert not batches.read_batch(spark, directory, "customers").isEmpty()

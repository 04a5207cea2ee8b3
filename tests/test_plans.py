"""Physical plans: pruning, pushdown, no Python, and hot keys split at run time."""

from __future__ import annotations

import ast
from contextlib import contextmanager
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oreline.operators import facts, marts, quality
from oreline.operators.absent import keys_shared
from oreline.plans import testdata as td
from oreline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    old = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if old[k] is None else spark.conf.set(n, old[k])


SHUFFLED = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
SKEW = {
    **SHUFFLED,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1k",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "2k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    # splits follow map outputs, of which merged partitions of this small data leave one
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_fact_scan_is_pruned_and_filtered(spark):
    fact = facts.build_fact(td.orders(spark, SF), td.order_items(spark, SF), td.products(spark, SF), "F")
    text = plan(fact)
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in text
    assert "l_tax" not in text and "o_totalprice" not in text


def test_small_mart_filters_before_the_aggregation(spark, tmp_path):
    """With a mart that can be broadcast, rows of known grains are dropped unshuffled."""
    products = td.products(spark, SF)
    fact = facts.build_fact(td.orders(spark, SF), td.order_items(spark, SF), products, "F")
    fact.write.parquet(str(tmp_path / "fact"))
    marts.daily_sales(fact, products).write.parquet(str(tmp_path / "mart"))
    fact, mart = spark.read.parquet(str(tmp_path / "fact")), spark.read.parquet(str(tmp_path / "mart"))
    text = plan(marts.new_daily_sales(mart, fact, products))
    assert text.index("HashAggregate") < text.index("LeftAnti")
    with settings(spark, **SHUFFLED):
        text = plan(marts.new_daily_sales(mart, fact, products))
        assert text.index("LeftAnti") < text.index("HashAggregate")


def test_small_batch_leaves_the_history_unshuffled(spark):
    """The batch's keys go to the scan of the history; otherwise both sides dedupe first."""
    history, batch = td.order_items(spark, SF), td.orders(spark, SF)
    text = plan(keys_shared(history, batch, ["order_id"]))
    assert text.index("HashAggregate") < text.index("LeftSemi")
    with settings(spark, **SHUFFLED):
        lines = plan(keys_shared(history, batch, ["order_id"])).splitlines()
    assert "LeftSemi" in lines[1] and "SortMergeJoin" in lines[1]
    shuffles = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(" in l]
    assert len(shuffles) == 2 and all("HashAggregate" in lines[i + 1] for i in shuffles)


def hot_sales(spark, tmp_path):
    """Files in which one order and one product hold a third of all lines."""
    lines = spark.range(30000).select(
        F.col("id").cast("string").alias("order_item_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("order_id"),
        F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 400).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit("2.00").cast("decimal(14,2)").alias("unit_price_at_sale"),
        F.lit(0.0).alias("discount_pct"),
    )
    orders = spark.range(30000).select(
        F.col("id").alias("order_id"),
        F.col("id").alias("customer_id"),
        F.lit("2026-01-01 10:00:00").cast("timestamp").alias("order_date"),
        F.lit("web").alias("channel"),
        F.lit("completed").alias("status"),
    )
    products = spark.range(400).select(
        F.col("id").alias("product_id"), F.lit("c").alias("category"), F.lit("1.00").cast("decimal(14,2)").alias("cost")
    )
    tables = []
    for name, df in (("orders", orders), ("lines", lines), ("products", products)):
        df.repartition(8).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    return tables


def test_hot_order_and_product_are_split(spark, tmp_path):
    orders, lines, products = hot_sales(spark, tmp_path)
    with settings(spark, **SKEW):
        fact = facts.build_fact(orders, lines, products)
        text = final_plan(fact)
        assert text.count("SortMergeJoin(skew=true)") == 2
        assert fact.count() == 30000


def test_hot_product_is_split_in_the_mart_too(spark, tmp_path):
    """Both joins by product, though the first leaves the fact dealt out by product."""
    orders, lines, products = hot_sales(spark, tmp_path)
    with settings(spark, **SKEW):
        mart = marts.daily_sales(facts.build_fact(orders, lines, products), products)
        assert final_plan(mart).count("SortMergeJoin(skew=true)") == 3
        stored = mart.where("category = 'other'")
        added = marts.new_daily_sales(stored, facts.build_fact(orders, lines, products), products)
        assert final_plan(added).count("SortMergeJoin(skew=true)") == 3


def test_touched_rows_leave_closed_history_alone(spark):
    text = plan(QUERIES["scd2_touched_rows"](spark, SF))
    scans = [l for l in text.splitlines() if "FileScan" in l and "is_current" in l]
    assert scans and all("is_current" in l.split("PartitionFilters: [")[1].split("]")[0] for l in scans)


def test_time_travel_opens_only_earlier_commits(spark):
    for name in ("time_travel_rows", "time_travel_count", "time_travel_after_removal"):
        text = plan(QUERIES[name](spark, SF))
        assert "added_snapshot" in text.split("PartitionFilters: [")[1].split("]")[0], name


def test_sql_checks_push_their_condition(spark):
    assert "Or(LessThan(" in plan(
        quality.evaluate(
            spark,
            {"line": spark.read.parquet(f"{SF}/lineitem.parquet")},
            {"tables": [{"table": "line", "checks": [{"name": "a", "type": "sql", "query": "SELECT count(*) FROM line WHERE l_discount < 0 OR l_discount > 0.5"}]}]},
            date(2026, 1, 1),
        )
    )


def test_hot_order_is_split_behind_the_anti_join_too(spark, tmp_path):
    orders, lines, products = hot_sales(spark, tmp_path)
    stored = facts.build_fact(orders.where("order_id >= 20000"), lines, products)
    stored.write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    with settings(spark, **SKEW):
        added = facts.new_sales(fact, orders, lines, products)
        text = final_plan(added)
        inner = [l for l in text.splitlines() if "skew=true" in l and "Inner" in l]
        assert any("order_id" in l for l in inner) and any("product_id" in l for l in inner)
        assert added.count() + fact.count() == 30000


def test_hot_customer_is_split(spark, tmp_path):
    fact = spark.range(60000).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("customer_id"),
        F.lit("1.00").cast("decimal(14,2)").alias("gross_amount"),
    )
    customers = spark.range(5000).select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("segment"),
        F.lit(True).alias("is_current"),
    )
    for name, df in (("fact", fact), ("customers", customers)):
        df.repartition(8).write.parquet(str(tmp_path / name))
    with settings(spark, **SKEW):
        mart = marts.customer_segments(
            spark.read.parquet(str(tmp_path / "fact")), spark.read.parquet(str(tmp_path / "customers"))
        )
        rows = {r.segment: r for r in mart.collect()}
        text = plan(mart).split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in text
    assert sum(r.total_gross for r in rows.values()) == 60000
    assert sum(r.customers for r in rows.values()) == 5000


def test_keys_of_a_reference_check_are_reduced_before_the_shuffle(spark):
    suite = {
        "tables": [
            {"table": "lines", "checks": [{"name": "a", "type": "fk", "column": "order_id", "ref_table": "orders"}]}
        ]
    }
    tables = {"lines": td.order_items(spark, SF), "orders": td.orders(spark, SF)}
    with settings(spark, **SHUFFLED):
        text = plan(quality.evaluate(spark, tables, suite, date(2026, 1, 1)))
    shuffles = [i for i, l in enumerate(text.splitlines()) if "Exchange hashpartitioning(" in l]
    assert len(shuffles) == 2
    assert all("HashAggregate" in text.splitlines()[i + 1] for i in shuffles)


def test_dimension_steps_share_one_partitioning(spark):
    """Four shuffles, all by customer: the change set is planned twice and computed once."""
    with settings(spark, **SHUFFLED):
        text = final_plan(QUERIES["scd2_apply"](spark, SF))
    done = [l for l in text.splitlines() if "Exchange hashpartitioning" in l]
    fresh = [l for l in done if "ReusedExchange" not in l]
    assert len(fresh) == 4 and len(done) == 7
    assert all("hashpartitioning(customer_id#" in l and "hash_value" not in l.split("hashpartitioning")[1] for l in fresh)


def test_checks_of_a_table_share_one_scan(spark):
    checks = [
        {"name": "a", "type": "not_null", "column": "order_id"},
        {"name": "b", "type": "positive", "column": "quantity"},
        {"name": "c", "type": "in_set", "column": "quantity", "values": [1]},
        {"name": "d", "type": "row_count", "min": 1},
    ]
    suite = {"tables": [{"table": "lines", "checks": checks}]}
    found = quality.evaluate(spark, {"lines": td.order_items(spark, SF)}, suite, date(2026, 1, 1))
    text = plan(found)
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_library_has_no_row_functions_or_rdds():
    banned = {"udf", "pandas_udf", "rdd", "mapPartitions", "toPandas", "toLocalIterator", "crossJoin", "localCheckpoint"}
    library = Path(__file__).resolve().parents[1] / "oreline"
    for source in library.rglob("*.py"):
        if library / "llm" in source.parents:  # a part of its own, with its own tests
            continue
        names = {n.attr for n in ast.walk(ast.parse(source.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & banned, source

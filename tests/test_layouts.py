"""Bucketed facts, facts by month, and compaction that the history records."""

from __future__ import annotations

import os
import uuid
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oreline.operators import compaction, facts, history, marts
from oreline.plans import retail
from oreline.plans import testdata as td
from oreline.sources import catalog
from oreline.sources.batches import batch_file
from tests.test_pipeline import entities
from tests.test_plans import SHUFFLED, final_plan, plan, settings

SF = "/root/testdata/sf0.001"


def write_batch(base, tables, number):
    folder = base / f"batch{number}"
    folder.mkdir(parents=True)
    for name, df in tables.items():
        df.write.option("header", True).csv(batch_file(str(folder), name))
    return str(folder)


# -- buckets -----------------------------------------------------------------


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """Items and a fact of the first batch, bucketed by order."""
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    retail.create_tables(spark, str(tmp_path_factory.mktemp("buckets")), prefix, buckets=16)
    names = f"{prefix}bronze.order_items", f"{prefix}silver.fact_sales"
    catalog.insert(td.order_items(spark, SF).withColumn("batch_id", F.lit(1)), names[0])
    first = td.order_batch(spark, SF, 1)
    fact = facts.build_fact(first, spark.table(names[0]), td.products(spark, SF), td.COMPLETED)
    catalog.insert(fact, names[1])
    return tuple(spark.table(n) for n in names)


def test_bucketing_is_read_from_the_catalog(spark, bucketed, tmp_path):
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    retail.create_tables(spark, str(tmp_path), prefix, buckets=4)
    assert catalog.bucketing(spark, f"{prefix}silver.fact_sales") == (4, ["order_id"])
    assert catalog.bucketing(spark, f"{prefix}silver.dim_products") == (0, [])


def above(lines, mark):
    """Operators over the scan whose line holds ``mark``."""
    at = next(i for i, line in enumerate(lines) if mark in line)
    out, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-*(0123456789)"))
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if indent < depth:
            out.append(line)
            depth = indent
    return out


def test_stored_fact_and_items_are_not_shuffled(spark, bucketed):
    items, fact = bucketed
    orders = td.order_batch(spark, SF, 2)
    with settings(spark, **SHUFFLED):
        old = facts.FEW_ORDERS
        facts.FEW_ORDERS = 0
        try:
            added = facts.new_sales_colocated(fact, orders, items, td.products(spark, SF), td.COMPLETED)
        finally:
            facts.FEW_ORDERS = old
        text = plan(added)
    scans = [line for line in text.splitlines() if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 2 and all("SelectedBucketsCount: 16 out of 16" in s for s in scans)
    # The batch is dealt by order, the joined lines and the products by product; nothing else.
    shuffles = [line.split("hashpartitioning(")[1].split("#")[0] for line in text.splitlines() if "Exchange" in line]
    assert sorted(shuffles) == ["o_orderkey", "p_partkey", "product_id"] or sorted(shuffles) == ["o_orderkey", "product_id", "product_id"]
    body = text.splitlines()
    for mark in ("silver.fact_sales", "bronze.order_items"):
        path = above(body, mark)
        join = next(i for i, line in enumerate(path) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in path[:join])


def test_a_few_orders_open_their_buckets_only(spark, bucketed):
    items, fact = bucketed
    orders = td.order_batch(spark, SF, 2).where("order_id % 50 = 0").orderBy("order_id").limit(2)
    added = facts.new_sales_colocated(fact, orders, items, td.products(spark, SF), td.COMPLETED)
    scans = [line for line in plan(added).splitlines() if "SelectedBucketsCount" in line]
    assert scans and not any("16 out of 16" in s for s in scans)
    # Both scans get the ids, also where the other one need not keep to its buckets.
    for table in ("silver.fact_sales", "bronze.order_items"):
        (scan,) = [line for line in plan(added).splitlines() if table in line]
        assert "(order_id#" in scan.split("DataFilters")[1] and ("EqualTo(order_id" in scan or "In(order_id" in scan)


@pytest.mark.parametrize("few", [0, 1000])
def test_colocated_sales_equal_new_sales(spark, bucketed, monkeypatch, few):
    monkeypatch.setattr(facts, "FEW_ORDERS", few)
    items, fact = bucketed
    # An order without an id, one delivered twice, and known ones.
    orders = td.order_batch(spark, SF, 2)
    orders = orders.unionByName(orders.limit(3)).unionByName(orders.limit(1).withColumn("order_id", F.lit(None).cast("bigint")))
    args = fact, orders, items, td.products(spark, SF), td.COMPLETED
    assert sorted(map(str, facts.new_sales_colocated(*args).collect())) == sorted(map(str, facts.new_sales(*args).collect()))


def test_a_bucket_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    """One order holds nearly everything: its bucket gets several files, none is missing rows."""
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    retail.create_tables(spark, str(tmp_path), prefix, buckets=4)
    lines = spark.range(40_000).select(
        F.concat(F.lit("item-"), F.col("id"), F.sha2(F.col("id").cast("string"), 256)).alias("order_item_id"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("order_id"),
        F.col("id").alias("product_id"), F.lit(1).alias("quantity"),
        F.lit("1.00").cast("decimal(14,2)").alias("unit_price_at_sale"), F.lit(0.0).alias("discount_pct"),
        F.lit(1).alias("batch_id"),
    ).repartition(8)
    with settings(
        spark,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1k",
    ):
        catalog.insert(lines, f"{prefix}bronze.order_items")
    table = spark.table(f"{prefix}bronze.order_items")
    files = table.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.max(F.col("order_id") == 7).alias("hot"))
    assert files.where("hot").count() > 2 and table.count() == 40_000


# -- months ------------------------------------------------------------------


def sale(order, day, channel, product=1, gross="10.00"):
    return (order, day and datetime.fromisoformat(f"{day}T10:00:00"), channel, product, 1, gross, "4.00")


SALE = "order_id bigint, order_date timestamp, channel string, product_id bigint, quantity int, gross_amount string, cost_amount string"


def monthly(spark, rows, path):
    df = spark.createDataFrame(rows, SALE).withColumns(
        {c: F.col(c).cast("decimal(14,2)") for c in ("gross_amount", "cost_amount")}
    )
    df = df.withColumn("sale_month", marts.sale_month("order_date"))
    df.write.mode("append").partitionBy("sale_month").parquet(path)
    return df


@pytest.fixture
def products(spark):
    return spark.createDataFrame([(1, "toys"), (2, "food")], "product_id bigint, category string")


def test_loaded_months_are_not_opened(spark, tmp_path, products):
    """The mart is not broadcast; unreadable files in months it lacks nothing of do no harm."""
    path = str(tmp_path / "fact")
    known = monthly(spark, [sale(i, f"2026-{m:02d}-03", "web") for i, m in enumerate(range(1, 7))], path)
    mart = marts.daily_sales(known, products).withColumn("sale_month", marts.sale_month("sale_date"))
    mart.write.partitionBy("sale_month").parquet(str(tmp_path / "mart"))
    # A late fact of a known grain, one of a new channel on a known day, one of a new month.
    added = monthly(
        spark, [sale(20, "2026-02-03", "web"), sale(21, "2026-03-03", "shop"), sale(22, "2026-07-01", "web")], path
    )
    for month in (1, 2, 4, 5, 6):
        for folder in ("fact", "mart"):
            for file in Path(tmp_path / folder / f"sale_month=2026-{month:02d}-01").glob("*.parquet"):
                if folder == "fact" or month != 2:
                    os.chmod(file, 0o644)
                    file.write_bytes(b"not parquet")
                    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    fact, mart = spark.read.schema(added.schema).parquet(path), spark.read.schema(mart.schema).parquet(str(tmp_path / "mart"))
    with settings(spark, **SHUFFLED):
        new = marts.new_daily_sales_since(mart, fact, added, products)
        assert "dynamicpruning" in plan(new)
        found = sorted((str(r.sale_date), r.channel, r.orders) for r in new.collect())
    # March: the known channel is not refreshed, the new one is added.
    assert found == [("2026-03-03", "shop", 1), ("2026-07-01", "web", 1)]


def test_pruned_mart_equals_the_whole_one(spark, tmp_path, products):
    """Late facts, new grains on old days, and NULLs in every part of the grain."""
    path = str(tmp_path / "fact")
    first = [sale(1, "2026-01-01", "web"), sale(2, "2026-01-01", None), sale(3, None, "web"), sale(4, "2026-02-01", "web", 2)]
    known = monthly(spark, first, path)
    mart = marts.daily_sales(known, products)
    mart.write.parquet(str(tmp_path / "mart"))
    mart = spark.read.parquet(str(tmp_path / "mart"))
    more = [sale(5, "2026-01-01", "web"), sale(6, "2026-01-01", None), sale(7, None, "web"), sale(8, "2026-02-01", "web", 1),
            sale(9, "2026-01-01", "shop"), sale(10, "2026-01-01", "shop"), sale(11, "2026-01-01", "web", 99)]
    added = monthly(spark, more, path)
    fact = spark.read.schema(added.schema).parquet(path)
    pruned = marts.new_daily_sales_since(mart, fact, added, products)
    whole = marts.new_daily_sales(mart, fact, products)
    assert sorted(map(str, pruned.collect())) == sorted(map(str, whole.collect()))
    assert pruned.columns == whole.columns
    assert marts.new_daily_sales_since(mart, fact, added.limit(0), products).collect() == []


def test_layouts_change_no_result(spark, tmp_path):
    tables = {}
    for name, options in (("plain", {}), ("laid_out", {"buckets": 2, "by_month": True})):
        prefix = f"t{uuid.uuid4().hex[:8]}_"
        retail.create_tables(spark, str(tmp_path / name), prefix, **options)
        for n in (1, 2):
            batch = write_batch(tmp_path / name, entities(spark, n), n)
            retail.load_bronze(spark, batch, prefix)
            added = retail.build_silver(spark, date(2026, 11, n), n, prefix)
            retail.build_gold(spark, prefix, added if options else None)
        tables[name] = {
            t: sorted(str(r) for r in spark.table(prefix + t).drop("sale_month").collect())
            for t in ("silver.fact_sales", "gold.daily_sales", "gold.customer_segments")
        }
    assert tables["plain"] == tables["laid_out"]
    assert all(tables["plain"].values())


# -- compaction --------------------------------------------------------------

VERSIONED = "id BIGINT, name STRING, removed_snapshot BIGINT, added_snapshot BIGINT"
NOW = datetime(2026, 3, 1)


@pytest.fixture
def stored_history(spark, tmp_path):
    """Commit 1: twelve small files and a large one; commit 2: three small ones; 3 removes."""
    text = F.sha2(F.col("id").cast("string"), 256)

    def rows(low, high, added):
        return spark.range(low, high).select(
            "id", text.alias("name"),
            F.when(F.col("id") % 10 == 0, 3).cast("bigint").alias("removed_snapshot"),
            F.lit(added).cast("bigint").alias("added_snapshot"),
        )

    log = spark.createDataFrame(
        [(1, datetime(2026, 1, 1), "append"), (2, datetime(2026, 1, 2), "append"), (3, datetime(2026, 1, 3), "delete")],
        "snapshot_id bigint, committed_at timestamp, operation string",
    )
    path = str(tmp_path / "history")
    compaction.write_history(rows(0, 1200, 1).repartition(12), log, path)
    for part in (rows(1200, 9200, 1).coalesce(1), rows(9200, 9500, 2).repartition(3)):
        part.withColumn("pack", F.lit(0)).write.mode("append").partitionBy("pack", "added_snapshot").parquet(f"{path}/rows")
    return path


def shown(spark, path, snapshot):
    rows, log = compaction.read_history(spark, path, VERSIONED), compaction.read_log(spark, path)
    return sorted(map(tuple, history.as_of(rows, log, snapshot).collect()))


def files(spark, path):
    return {r["file"]: r["rows"] for r in compaction.live_files(spark, path, VERSIONED).collect()}


def test_only_small_files_are_rewritten(spark, stored_history):
    before = {n: shown(spark, stored_history, n) for n in (1, 2, 3)}
    old = files(spark, stored_history)
    assert len(old) == 16 and max(old.values()) == 8000
    done = compaction.compact_small(spark, stored_history, VERSIONED, 1 << 18, NOW).collect()
    assert [tuple(r) for r in done] == [(4, 15, 1500)]
    new = files(spark, stored_history)
    kept = old.keys() & new.keys()
    assert [old[f] for f in kept] == [8000] and len(new) == 3
    log = compaction.read_log(spark, stored_history)
    assert [(r.snapshot_id, r.operation) for r in history.snapshot_history(log).collect()][-1] == (4, "replace")
    assert {n: shown(spark, stored_history, n) for n in (1, 2, 3)} == before
    assert shown(spark, stored_history, 4) == before[3]
    # Replaced files can go at any time, also twice; nothing is left to do.
    assert compaction.delete_replaced(spark, stored_history) == 15
    assert compaction.delete_replaced(spark, stored_history) == 0
    assert {n: shown(spark, stored_history, n) for n in (1, 2, 3)} == before
    assert compaction.compact_small(spark, stored_history, VERSIONED, 1 << 18, NOW).count() == 0


def test_a_compaction_without_its_log_entry_does_not_count(spark, stored_history):
    before = shown(spark, stored_history, 3)
    lost = compaction.read_history(spark, stored_history, VERSIONED).limit(50)
    lost.write.partitionBy("added_snapshot").parquet(f"{stored_history}/rows/pack=4")
    assert shown(spark, stored_history, 3) == before
    compaction.compact_small(spark, stored_history, VERSIONED, 1 << 18, NOW)
    assert shown(spark, stored_history, 4) == before


def test_many_files_take_several_commits(spark, stored_history):
    before = shown(spark, stored_history, 3)
    done = compaction.compact_small(spark, stored_history, VERSIONED, 1 << 18, NOW, most=5).collect()
    assert len(done) > 1 and sum(r.files_replaced for r in done) >= 15 and all(r.files_replaced <= 5 for r in done)
    assert shown(spark, stored_history, 3) == before
    operations = [r.operation for r in history.snapshot_history(compaction.read_log(spark, stored_history)).collect()]
    assert operations.count("replace") == len(done)


def test_bins_follow_the_sizes(spark):
    sizes = [10, 90, 60, 30, 20, 74, 75, 500]
    rows = [(f"f{i}", 1, s) for i, s in enumerate(sizes)] + [("g", 2, 5)]
    found = compaction.bins(spark.createDataFrame(rows, "file string, added_snapshot bigint, bytes bigint"), 100)
    # Below three quarters of the target: 10 60 30 20 74 start at 0 10 70 100 120.
    assert sorted((r.file, r.bin) for r in found.collect()) == [("f0", 0), ("f2", 0), ("f3", 0), ("f4", 1), ("f5", 1)]


def test_a_history_follows_its_orders(spark, tmp_path):
    """Orders that change between two calls show in the second."""
    from oreline.plans.queries import QUERIES

    for table in ("orders",):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(50).write.parquet(str(tmp_path / f"{table}.parquet"))
    first = QUERIES["time_travel_rows"](spark, str(tmp_path)).count()
    more = spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)
    more.write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["time_travel_rows"](spark, str(tmp_path)).count() > first

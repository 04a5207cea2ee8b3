"""The whole retail pipeline over two CSV batches, as a user runs it."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from oreline.operators import dimensions, quality
from oreline.plans import retail
from oreline.schemas import RAW, TABLES, conform
from oreline.sources.batches import batch_file
from oreline.sources.catalog import insert
from oreline.sources.paths import stored

RUN = date(2026, 8, 15)

def pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def entities(spark, number):
    """500 customers of whom 114 change in batch 2, 200 products, and new orders."""
    second = number == 2
    key = F.col("id")
    customers = spark.range(1, 501).select(
        key.alias("customer_id"),
        F.concat(F.lit("Customer "), key).alias("name"),
        F.when(F.lit(second) & (key % 7 == 0), "Moved").otherwise(pick(["Rome", "Oslo", "Bonn"], key)).alias("city"),
        F.when(F.lit(second) & (key % 10 == 0), pick(["professional", "enterprise", "consumer"], key))
        .otherwise(pick(["consumer", "professional", "enterprise"], key))
        .alias("segment"),
        F.date_add(F.lit(date(2025, 1, 1)), (key % 300).cast("int")).alias("signup_date"),
    )
    products = spark.range(1, 201).select(
        key.alias("product_id"),
        F.concat(F.lit("SKU"), key).alias("sku"),
        F.concat(F.lit("Product "), key).alias("name"),
        pick(["home", "toys", "books", "food"], key).alias("category"),
        pick(["a", "b", "c", "d", "e"], key).alias("subcategory"),
        (key + 10).alias("unit_price"),
        (key / 2 + 5).alias("cost"),
        F.lit(date(2026, 1, 1)).alias("launch_date"),
    )
    low, high = (0, 4000) if number == 1 else (4000, 6000)
    orders = spark.range(low, high).select(
        key.alias("order_id"),
        (key * 7 % 500 + 1).alias("customer_id"),
        F.timestamp_seconds(F.lit(1767225600) + key * 5256).alias("order_date"),
        pick(["marketplace", "website", "pos"], key).alias("channel"),
        pick(["completed"] * 4 + ["cancelled"], key).alias("status"),
    )
    items = spark.range(low * 3, high * 3).select(
        F.concat(F.lit("item-"), key).alias("order_item_id"),
        F.floor(key / 3).alias("order_id"),
        (key * 13 % 200 + 1).alias("product_id"),
        (key % 4 + 1).alias("quantity"),
        (key * 13 % 200 + 11).alias("unit_price_at_sale"),
        pick([0.0, 0.1, 0.15, 0.25], key).alias("discount_pct"),
    )
    made = {"customers": customers, "products": products, "orders": orders, "order_items": items}
    return {name: conform(df, RAW[name]) for name, df in made.items()}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("retail")
    retail.create_tables(spark, str(base / "warehouse"))
    seen = {}
    for number in (1, 2):
        folder = base / f"batch{number}"
        folder.mkdir()
        for name, df in entities(spark, number).items():
            df.write.option("header", True).csv(batch_file(str(folder), name))
        seen[f"counts{number}"] = retail.load_bronze(spark, str(folder)).collect()
        retail.build_silver(spark, date(2026, 11 + number - 1, 30), batch=number)
    seen["folder"] = str(folder)
    retail.build_gold(spark)
    yield seen
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"DROP SCHEMA {layer} CASCADE")


def test_ingest_audit(run):
    for number, orders in ((1, 4000), (2, 2000)):
        assert {(r.entity, r.batch_id, r.row_count) for r in run[f"counts{number}"]} == {
            ("customers", number, 500),
            ("products", number, 200),
            ("orders", number, orders),
            ("order_items", number, orders * 3),
        }


def test_work_on_one_batch_opens_no_file_of_another(spark, run):
    second = spark.table("bronze.order_items").where("batch_id = 2")
    files = {r[0] for r in second.select("_metadata.file_path").distinct().collect()}
    assert files and all("/batch_id=2/" in f for f in files)
    text = second._jdf.queryExecution().executedPlan().toString()
    assert "batch_id" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_silver_state(spark, run):
    dim = spark.table("silver.dim_customers")
    assert dim.count() == 614 and dim.where("NOT is_current").count() == 114
    assert dimensions.current(dim).count() == 500
    assert spark.table("silver.dim_products").count() == 200
    assert spark.table("silver.fact_sales").count() == 6000 * 4 // 5 * 3


def test_stored_tables_follow_their_schema(spark, run):
    for name, declared in TABLES.items():
        kinds = dict(spark.table(name).dtypes)
        kinds.pop("batch_id", None)
        assert kinds == {f.name: f.dataType.simpleString() for f in declared.fields}, name


def test_quality_reproduces_the_published_outcome(spark, run):
    """41 checks, 40 passed, WARN: only the customer history repeats keys, 114 of them."""
    results = retail.check_quality(spark, RUN).cache()
    failed = [(r.table_name, r.check_type, r.severity, r.measured) for r in results.where("NOT passed").collect()]
    assert failed == [("silver.dim_customers", "unique", "warn", "114")]
    assert tuple(quality.gate_counts(results).first()) == (0, 1, 40, 41)
    assert quality.overall_status(results).first()[0] == "WARN"
    quality.enforce(results)


def test_a_second_run_of_every_step_adds_nothing(spark, run):
    names = [t for t in TABLES if not t.startswith("bronze.")]
    before = {t: spark.table(t).count() for t in names}
    retail.load_bronze(spark, run["folder"], skip_loaded=True)
    retail.build_silver(spark, date(2026, 12, 30), batch=2)
    retail.build_silver(spark, date(2026, 12, 30))
    retail.build_gold(spark)
    assert {t: spark.table(t).count() for t in names} == before


def test_a_batch_leaves_closed_history_files_alone(spark, run):
    """Two changes at later dates: rows closed before stay in the files they were in."""
    closed = "NOT is_current AND valid_to = DATE '2026-12-30'"
    files = lambda: {r[0] for r in spark.table("silver.dim_customers").where(closed).select("_metadata.file_path").distinct().collect()}
    before, rows = files(), spark.table("silver.dim_customers").count()
    moved = spark.table("bronze.customers").where("batch_id = 2 AND customer_id <= 9").withColumn("city", F.lit("Elsewhere"))
    for number in (3, 4):
        batch = moved.withColumns({"batch_id": F.lit(number), "city": F.concat("city", F.lit(str(number)))})
        insert(stored(batch, "moved"), "bronze.customers")
        retail.build_silver(spark, date(2027, 1, 31), batch=number)
    assert before and files() == before
    dim = spark.table("silver.dim_customers")
    assert dim.count() == rows + 18 and dimensions.current(dim).count() == 500
    assert dim.where("valid_to = DATE '2027-01-31'").count() == 18

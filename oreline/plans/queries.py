"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.functions import row_hash
from oreline.operators import bitmaps, compaction, dimensions, facts, history, marts, quality
from oreline.plans import retail, testdata as td
from oreline.plans.retail_suite import adapted
from oreline.schemas import TABLES
from oreline.sources import batches, catalog
from oreline.sources.paths import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]


# -- bronze ------------------------------------------------------------------


def bronze_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customers_b1.csv")
    td.customers(spark, sf_dir).write.option("header", True).csv(path)
    return batches.read_csv(spark, path, "customers")


def _bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bronze_orders")
    for number in (1, 2):
        batch = td.order_batch(spark, sf_dir, number).withColumn("batch_id", F.lit(number))
        batches.append_batch(batch, path)
    return spark.read.parquet(path)


def bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_orders(spark, sf_dir)


def ingest_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.row_counts({"orders": _bronze_orders(spark, sf_dir)})


def _warehouse(spark: SparkSession) -> str:
    """Empty tables of a new warehouse; returns the prefix of its schemas."""
    prefix = f"w{uuid.uuid4().hex[:12]}_"
    retail.create_tables(spark, scratch_path(spark, "warehouse"), prefix)
    return prefix


def bronze_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per entity of two CSV batches, loaded into the bronze tables."""
    prefix = _warehouse(spark)
    first, second = (
        retail.load_bronze(spark, batch, prefix) for batch in td.write_batches(spark, sf_dir)
    )
    return first.unionByName(second)


def bronze_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed order lines (DECIMAL price, DOUBLE discount) of both CSV batches."""
    first, second = (
        batches.read_batch(spark, batch, "order_items") for batch in td.write_batches(spark, sf_dir)
    )
    return first.unionByName(second)


def catalog_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a named table."""
    name = f"{_warehouse(spark)}silver.dim_products"
    early = F.col("launch_date") < F.lit("1991-06-01").cast("date")
    for part in (early, ~early):
        catalog.insert(td.products(spark, sf_dir).where(part), name)
    return spark.table(name)


# -- silver ------------------------------------------------------------------


def scd2_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.customers(spark, sf_dir).select(
        "customer_id", row_hash(dimensions.CUSTOMER_TRACKED).alias("hash_value")
    )


def _first_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.scd2_open(td.customers(spark, sf_dir), td.EFFECTIVE)


def scd2_detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.scd2_detect(
        _first_dim(spark, sf_dir), td.customers_second(spark, sf_dir), td.EFFECTIVE
    )


def scd2_close_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _first_dim(spark, sf_dir)
    changes = dimensions.scd2_detect(dim, td.customers_second(spark, sf_dir), td.EFFECTIVE)
    return dimensions.scd2_close(dim, changes, td.EFFECTIVE)


def scd2_touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch changes in a stored dimension, of which only current rows are read."""
    dim = _first_dim(spark, sf_dir)
    path = scratch_path(spark, "dim_customers")
    dim.write.partitionBy("is_current").parquet(path)
    dim = spark.read.schema(dim.schema).parquet(path).select(*dim.columns)
    return dimensions.scd2_touched(dim, td.customers_second(spark, sf_dir), td.EFFECTIVE)


def scd2_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.scd2_apply(
        _first_dim(spark, sf_dir), td.customers_second(spark, sf_dir), td.EFFECTIVE
    )


def scd2_apply_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scd2_apply`` over a stored change set."""
    return dimensions.scd2_apply_frozen(
        _first_dim(spark, sf_dir), td.customers_second(spark, sf_dir), td.EFFECTIVE
    )


def scd2_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both batches arrive together: every key twice, the later row counts."""
    both = td.customers(spark, sf_dir).withColumn("batch_id", F.lit(1)).unionByName(
        td.customers_second(spark, sf_dir).withColumn("batch_id", F.lit(2))
    )
    return dimensions.scd2_apply(
        _first_dim(spark, sf_dir), both, td.EFFECTIVE, order_by=["batch_id"]
    )


def scd2_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch arrives twice; the second time nothing changes."""
    return dimensions.scd2_apply(
        scd2_apply(spark, sf_dir), td.customers_second(spark, sf_dir), td.EFFECTIVE
    )


def dim_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.current(scd2_apply(spark, sf_dir))


def dim_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension holds the products of the first launch years; all are delivered, at new
    prices, which the stored ones must not take on."""
    loaded = td.products(spark, sf_dir).where(F.col("launch_date") < F.lit("1991-06-01").cast("date"))
    return loaded.unionByName(dimensions.insert_new(loaded, td.products_second(spark, sf_dir)))


def _fact(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    return facts.build_fact(
        orders, td.order_items(spark, sf_dir), td.products(spark, sf_dir), td.COMPLETED
    )


def _zone_free(fact: DataFrame) -> DataFrame:
    return fact.withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone_free(_fact(spark, sf_dir, td.orders(spark, sf_dir)))


def fact_sales_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discount as raw files declare it, in floating point."""
    items = td.order_items(spark, sf_dir).withColumn("discount_pct", F.col("discount_pct").cast("double"))
    fact = facts.build_fact(td.orders(spark, sf_dir), items, td.products(spark, sf_dir), td.COMPLETED)
    return _zone_free(fact)


def retail_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact after the whole pipeline ran over two CSV batches."""
    prefix = _warehouse(spark)
    for number, batch in enumerate(td.write_batches(spark, sf_dir), 1):
        retail.load_bronze(spark, batch, prefix)
        retail.build_silver(spark, td.EFFECTIVE, number, prefix)
    return _zone_free(spark.table(f"{prefix}silver.fact_sales"))


def fact_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 2 repeats orders of batch 1; none of them may enter the fact twice."""
    # Read twice, for its keys and for its rows.
    fact = stored(_fact(spark, sf_dir, td.order_batch(spark, sf_dir, 1)), "fact")
    added = facts.new_sales(
        fact,
        td.order_batch(spark, sf_dir, 2),
        td.order_items(spark, sf_dir),
        td.products(spark, sf_dir),
        td.COMPLETED,
    )
    return _zone_free(fact.unionByName(added))


def fact_bucketed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fact_incremental`` over items and a fact bucketed by order: neither is shuffled."""
    prefix = f"w{uuid.uuid4().hex[:12]}_"
    retail.create_tables(spark, scratch_path(spark, "warehouse"), prefix, buckets=16)
    items, fact = f"{prefix}bronze.order_items", f"{prefix}silver.fact_sales"
    products = td.products(spark, sf_dir)
    catalog.insert(td.order_items(spark, sf_dir).withColumn("batch_id", F.lit(1)), items)
    for number in (1, 2):
        orders = td.order_batch(spark, sf_dir, number)
        added = facts.new_sales_colocated(
            spark.table(fact), orders, spark.table(items), products, td.COMPLETED
        )
        catalog.insert(added, fact)
    return _zone_free(spark.table(fact))


# -- gold --------------------------------------------------------------------


def gold_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = _fact(spark, sf_dir, td.orders(spark, sf_dir))
    return marts.daily_sales(fact, td.products(spark, sf_dir))


def gold_customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = _fact(spark, sf_dir, td.orders(spark, sf_dir))
    return marts.customer_segments(fact, scd2_apply(spark, sf_dir))


def gold_daily_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart was built when only early shipments were known; its rows stay as they are."""
    products = td.products(spark, sf_dir)
    early = facts.build_fact(
        td.orders(spark, sf_dir),
        td.order_items(spark, sf_dir, shipped_before=td.SECOND_BATCH_FROM),
        products,
        td.COMPLETED,
    )
    mart = marts.daily_sales(early, products)
    fact = _fact(spark, sf_dir, td.orders(spark, sf_dir))
    return mart.unionByName(marts.new_daily_sales(mart, fact, products))


def gold_daily_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gold_daily_incremental`` over a fact and a mart partitioned by month, of which only
    months with a grain that the mart lacks are read."""
    products, orders = td.products(spark, sf_dir), td.orders(spark, sf_dir)
    known = td.order_items(spark, sf_dir, shipped_before=td.SECOND_BATCH_FROM)
    early = facts.build_fact(orders, known, products, td.COMPLETED)
    late = td.order_items(spark, sf_dir, shipped_from=td.SECOND_BATCH_FROM)
    late = facts.build_fact(orders, late, products, td.COMPLETED)
    paths = [scratch_path(spark, label) for label in ("fact", "mart")]
    for part in (early, late):
        monthly = part.withColumn("sale_month", marts.sale_month("order_date"))
        monthly.hint("rebalance", "sale_month").write.mode("append").partitionBy("sale_month").parquet(paths[0])
    mart = marts.daily_sales(early, products).withColumn("sale_month", marts.sale_month("sale_date"))
    mart.hint("rebalance", "sale_month").write.partitionBy("sale_month").parquet(paths[1])
    fact, mart = (spark.read.parquet(p) for p in paths)
    return mart.drop("sale_month").unionByName(marts.new_daily_sales_since(mart, fact, late, products))


def gold_segments_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart holds two segments, from the first order batch; the others are added."""
    customers = scd2_apply(spark, sf_dir)
    early = _fact(spark, sf_dir, td.order_batch(spark, sf_dir, 1))
    two = customers.where(F.col("segment").isin(td.SEGMENTS[:2]))
    mart = marts.customer_segments(early, two)
    fact = _fact(spark, sf_dir, td.orders(spark, sf_dir))
    return mart.unionByName(marts.new_customer_segments(mart, fact, customers))


def distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders per channel over both order batches, from the states of each."""
    by, states = ["channel"], {"customer_id": [], "order_id": []}
    for number in (1, 2):
        batch = td.order_batch(spark, sf_dir, number)
        for key, found in states.items():
            found.append(stored(bitmaps.key_sets(batch, by, key), f"{key}-sets"))
    customers = bitmaps.distinct_counts(bitmaps.united(states["customer_id"], by), by, "customers")
    orders = bitmaps.distinct_counts(bitmaps.united(states["order_id"], by), by, "orders")
    return customers.join(orders, by)


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the orders that have lines are not among those of the first batch."""
    lines = bitmaps.key_sets(td.order_items(spark, sf_dir), [], "order_id")
    known = bitmaps.key_sets(td.order_batch(spark, sf_dir, 1), [], "order_id")
    return bitmaps.missing(lines, known)


def dq_watched_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-pass checks of the orders, measured while they are written."""
    suite = {"tables": [t for t in full_suite()["tables"] if t["table"] == "raw_orders"]}
    watched = quality.watch(td.orders(spark, sf_dir), "raw_orders", suite, td.RUN_DATE)
    watched.rows.write.parquet(scratch_path(spark, "orders"))
    return watched.results()


# -- history -----------------------------------------------------------------


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshot_history(td.order_snapshots(spark, sf_dir))


def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.previous_snapshot(td.order_snapshots(spark, sf_dir))


def time_travel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.count_as_of(*td.stored_history(spark, sf_dir))


def time_travel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(*td.stored_history(spark, sf_dir), 1)


def time_travel_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(*td.stored_history(spark, sf_dir), 3)


def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small files become few; the rows stay the same."""
    many, few = scratch_path(spark, "orders_many"), scratch_path(spark, "orders_few")
    rows = td.versioned_orders(spark, sf_dir)
    writers = 2 * spark.sparkContext.defaultParallelism
    rows.repartition(writers).write.partitionBy("added_snapshot").parquet(many)
    history.compact(spark.read.schema(rows.schema).parquet(many), few, ["added_snapshot"])
    return spark.read.schema(rows.schema).parquet(few).select(*rows.columns)


def _compacted_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The versioned orders written as many small files, compacted once."""
    path, rows = scratch_path(spark, "history"), td.versioned_orders(spark, sf_dir)
    writers = 2 * spark.sparkContext.defaultParallelism
    compaction.write_history(rows.repartition(writers, "order_id"), td.order_snapshots(spark, sf_dir), path)
    compaction.compact_small(spark, path, rows.schema.toDDL(), 1 << 24, td.COMPACTED)
    versioned = compaction.read_history(spark, path, rows.schema.toDDL()).select(*rows.columns)
    return versioned, compaction.read_log(spark, path)


def compaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits after a compaction, which is one of them."""
    return history.snapshot_history(_compacted_history(spark, sf_dir)[1])


def compaction_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit before the compaction shows the rows it always had."""
    return history.as_of(*_compacted_history(spark, sf_dir), 2)


def expire_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.expire(*td.stored_history(spark, sf_dir), td.NOW)


def expire_snapshots_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month after the last commit only it is kept, and what it removed goes."""
    return history.expire(*td.stored_history(spark, sf_dir), td.LATER)


def expire_snapshots_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits are older than a week: the newest stays, and what it removed goes."""
    return history.expire(*td.stored_history(spark, sf_dir), td.NOW, days=7)


def expire_snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unexpired(td.order_snapshots(spark, sf_dir), td.NOW)


# -- quality -----------------------------------------------------------------

# One suite per check type; most pair a check that passes with one that does not.
CHECKS: dict[str, tuple[str, list[dict]]] = {
    "dq_not_null": (
        "order_items",
        [{"name": "quantity_present", "type": "not_null", "column": "quantity"}],
    ),
    "dq_unique": (
        "order_items",
        [
            {"name": "line_distinct", "type": "unique", "columns": ["order_item_id"]},
            {
                "name": "line_product_distinct",
                "type": "unique",
                "columns": ["order_id", "product_id", "quantity", "discount_pct"],
                "severity": "warn",
            },
        ],
    ),
    "dq_positive": (
        "order_items",
        [
            {"name": "quantity_above_zero", "type": "positive", "column": "quantity"},
            {"name": "discount_above_zero", "type": "positive", "column": "discount_pct"},
        ],
    ),
    "dq_non_negative": (
        "daily_sales",
        [
            {"name": "units_not_negative", "type": "non_negative", "column": "units"},
            {"name": "margin_not_negative", "type": "non_negative", "column": "margin_amount"},
        ],
    ),
    "dq_in_set": (
        "raw_orders",
        [
            {"name": "status_known", "type": "in_set", "column": "status", "values": td.STATUSES},
            {"name": "status_final", "type": "in_set", "column": "status", "values": ["F", "O"]},
        ],
    ),
    "dq_row_count": (
        "raw_orders",
        [
            {"name": "orders_present", "type": "row_count", "min": 1},
            {"name": "orders_few", "type": "row_count", "max": 10, "severity": "warn"},
        ],
    ),
    "dq_min_date_before": (
        "raw_orders",
        [
            {
                "name": "starts_in_1995",
                "type": "min_date_before",
                "column": "order_date",
                "date": "1995-01-10",
            },
            {
                "name": "starts_in_1994",
                "type": "min_date_before",
                "column": "order_date",
                "date": "1994-12-31",
            },
        ],
    ),
    "dq_max_date_after": (
        "raw_orders",
        [
            {
                "name": "reaches_july",
                "type": "max_date_after",
                "column": "order_date",
                "date": "2001-07-20",
            },
            {
                "name": "reaches_september",
                "type": "max_date_after",
                "column": "order_date",
                "date": "2001-09-01",
            },
        ],
    ),
    "dq_max_age_days": (
        "raw_orders",
        [
            {"name": "fresh_month", "type": "max_age_days", "column": "order_date", "days": 30},
            {"name": "fresh_week", "type": "max_age_days", "column": "order_date", "days": 7},
        ],
    ),
    "dq_future_beyond": (
        "raw_orders",
        [
            {"name": "none_ahead", "type": "future_beyond", "column": "order_date", "days": 0},
            {"name": "none_recent", "type": "future_beyond", "column": "order_date", "days": -30},
        ],
    ),
    "dq_fk": (
        "raw_orders",
        [
            {"name": "order_has_lines", "type": "fk", "column": "order_id", "ref_table": "order_items"},
            {
                "name": "order_has_customer",
                "type": "fk",
                "column": "customer_id",
                "ref_table": "dim_customers",
            },
        ],
    ),
    "dq_sql": (
        "order_items",
        [
            {
                "name": "discount_in_range",
                "type": "sql",
                "query": "SELECT count(*) FROM order_items WHERE discount_pct < 0 OR discount_pct > 0.5",
            },
            {
                "name": "discount_small",
                "type": "sql",
                "query": "SELECT count(*) FROM order_items WHERE discount_pct < 0 OR discount_pct > 0.05",
            },
        ],
    ),
    "dq_scd2_one_current": (
        "dim_customers",
        [
            {
                "name": "single_current_row",
                "type": "sql",
                "query": "SELECT count(*) FROM (SELECT customer_id FROM dim_customers"
                " WHERE is_current GROUP BY customer_id HAVING count(*) > 1)",
            },
            {"name": "single_row", "type": "unique", "columns": ["customer_id"], "severity": "warn"},
        ],
    ),
    "dq_scd2_valid_window": (
        "dim_customers",
        [
            {
                "name": "valid_window",
                "type": "sql",
                "query": "SELECT count(*) FROM dim_customers WHERE valid_to < valid_from",
            }
        ],
    ),
}

# Checks that cannot be evaluated, and two neighbours that can.
BROKEN_SUITE = {
    "tables": [
        {
            "table": "raw_orders",
            "checks": [
                {"name": "id_present", "type": "not_null", "column": "order_id"},
                {"name": "no_such_column", "type": "not_null", "column": "coupon"},
                {"name": "text_above_zero", "type": "positive", "column": "channel"},
                {"name": "number_in_texts", "type": "in_set", "column": "order_id", "values": ["abc"]},
                {"name": "no_such_reference", "type": "fk", "column": "order_id", "ref_table": "returns"},
                {"name": "no_such_view", "type": "sql", "query": "SELECT count(*) FROM returns_view"},
                {
                    "name": "fails_when_run",
                    "type": "sql",
                    "query": "SELECT sum(CAST(channel AS INT)) FROM raw_orders",
                    "severity": "warn",
                },
                {"name": "status_known", "type": "in_set", "column": "status", "values": td.STATUSES},
            ],
        },
        {
            "table": "returns",
            "checks": [{"name": "no_such_table", "type": "row_count", "min": 1}],
        },
    ]
}


def _suite_tables(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    """The named tables of the retail model, each as a plan over the test tables."""
    products = td.products(spark, sf_dir)
    build: dict[str, Callable[[], DataFrame]] = {
        "customers": lambda: td.customers(spark, sf_dir).unionByName(td.customers_second(spark, sf_dir)),
        "products": lambda: products,
        "raw_orders": lambda: td.orders(spark, sf_dir),
        "order_items": lambda: td.order_items(spark, sf_dir),
        "dim_customers": lambda: scd2_apply(spark, sf_dir),
        "dim_products": lambda: products,
        "fact_sales": lambda: _fact(spark, sf_dir, td.orders(spark, sf_dir)),
        "daily_sales": lambda: gold_daily_sales(spark, sf_dir),
    }
    return {name: make() for name, make in build.items() if name in names}


def _stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables of the retail model.  The fact and the Type 2 dimension, which many checks
    read, are written out once, side by side; the marts are plans over them."""
    raw = {"customers", "products", "raw_orders", "order_items", "dim_products"}
    tables = _suite_tables(spark, sf_dir, raw)
    with ThreadPoolExecutor(2) as pool:
        fact, customers = pool.map(
            stored,
            (_fact(spark, sf_dir, tables["raw_orders"]), scd2_apply(spark, sf_dir)),
            ("fact_sales", "dim_customers"),
        )
    return {
        **tables,
        "fact_sales": fact,
        "dim_customers": customers,
        "daily_sales": marts.daily_sales(fact, tables["products"]),
        "customer_segments": marts.customer_segments(fact, customers),
    }


def _check_query(name: str) -> Query:
    table, checks = CHECKS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {table} | {c["ref_table"] for c in checks if "ref_table" in c}
        tables = _suite_tables(spark, sf_dir, names)
        return quality.evaluate(spark, tables, {"tables": [{"table": table, "checks": checks}]}, td.RUN_DATE)

    return run


# The retail tables under the names that the test data leave free.
_NAMES = {name: name.split(".")[1].replace("orders", "raw_orders") for name in TABLES}


def full_suite() -> dict:
    """The retail suite with the domains of the test data."""
    changes = {
        "bronze.customers.segment_in_whitelist": {"values": td.SEGMENTS},
        "bronze.orders.status_in_whitelist": {"values": td.STATUSES},
        "bronze.orders.channel_in_whitelist": {"values": td.CHANNELS},
        "bronze.orders.data_covers_january": {"date": "1995-01-10"},
        "bronze.orders.data_covers_december": {"date": "2001-07-20"},
        "silver.fact_sales.channel_in_whitelist": {"values": td.CHANNELS},
        "silver.fact_sales.row_count_range": {"min": 1, "max": 10**15},
    }
    return adapted(_NAMES, changes)


# Checks of catalog tables by name; %s stands for the prefix of the schemas.
CATALOG_SUITE = [
    {"name": "order_fk", "type": "fk", "column": "order_id", "ref_table": "%sbronze.orders"},
    {"name": "product_text_fk", "type": "fk", "column": "order_item_id", "ref_table": "%sbronze.products", "ref_column": "product_id", "severity": "warn"},
    {"name": "lines_present", "type": "row_count", "min": 1},
    {"name": "quantity_sold", "type": "sql", "query": "SELECT count(*) FROM %sbronze.order_items WHERE quantity <= 0"},
    {"name": "newest_order", "type": "sql", "query": "SELECT max(order_date) FROM %sbronze.orders", "severity": "warn"},
]


def dq_catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite whose tables are found in the catalog."""
    prefix = _warehouse(spark)
    for batch in td.write_batches(spark, sf_dir):
        retail.load_bronze(spark, batch, prefix)
    checks = [
        {k: v.replace("%s", prefix) if isinstance(v, str) else v for k, v in check.items()}
        for check in CATALOG_SUITE
    ]
    suite = {"tables": [{"table": f"{prefix}bronze.order_items", "checks": checks}]}
    found = quality.evaluate(spark, {}, suite, td.RUN_DATE)
    return found.withColumn("table_name", F.lit("bronze.order_items"))


def dq_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluate(spark, _stored_tables(spark, sf_dir), full_suite(), td.RUN_DATE)


def dq_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _suite_tables(spark, sf_dir, {"raw_orders"})
    return quality.run_suite(spark, tables, BROKEN_SUITE, td.RUN_DATE)


def dq_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overall_status(dq_suite(spark, sf_dir))


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the suite, its tables and checks unnested again."""
    report = quality.report(dq_suite(spark, sf_dir), td.NOW)
    tables = report.select("generated_at", "overall_status", F.posexplode("tables").alias("table_no", "t"))
    return tables.select(
        "generated_at", "overall_status", "table_no", F.col("t.table").alias("table_name"),
        F.posexplode("t.checks").alias("check_no", "c"),
    ).select("generated_at", "overall_status", "table_no", "table_name", "check_no", "c.*")


def dq_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate_counts(dq_suite(spark, sf_dir))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        bronze_csv_scan,
        bronze_append,
        ingest_row_counts,
        bronze_batches,
        bronze_order_lines,
        catalog_insert,
        scd2_row_hash,
        scd2_detect_changes,
        scd2_close_rows,
        scd2_touched_rows,
        scd2_apply,
        scd2_apply_frozen,
        scd2_repeated_keys,
        scd2_rerun,
        dim_current,
        dim_insert_new,
        fact_sales,
        fact_sales_double,
        retail_fact,
        fact_incremental,
        fact_bucketed_incremental,
        gold_daily_sales,
        gold_customer_segments,
        gold_daily_incremental,
        gold_daily_pruned,
        gold_segments_incremental,
        distinct_customers,
        orphan_orders,
        snapshot_history,
        previous_snapshot,
        time_travel_count,
        time_travel_rows,
        time_travel_after_removal,
        compact_files,
        compaction_log,
        compaction_time_travel,
        expire_snapshots,
        expire_snapshots_later,
        expire_snapshots_week,
        expire_snapshot_log,
    )
}
QUERIES.update({name: _check_query(name) for name in CHECKS})
QUERIES.update(
    {q.__name__: q for q in (
        dq_catalog_table, dq_watched_write, dq_suite, dq_error_isolation, dq_report, dq_overall_status, dq_gate_counts
    )}
)

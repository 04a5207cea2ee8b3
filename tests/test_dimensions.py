"""Type 2 and Type 0 dimensions: traps of the change rule and of repeated runs."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from oreline.functions import row_hash
from oreline.operators import dimensions as dims
from oreline.schemas import DIM_CUSTOMERS, RAW, conform

SIGNUP = date(2025, 1, 1)
FIRST, SECOND = date(2026, 6, 30), date(2026, 12, 31)


def customers(spark, *rows):
    return spark.createDataFrame([(i, f"n{i}", city, seg, SIGNUP) for i, city, seg in rows], RAW["customers"])


def empty_dim(spark):
    return spark.createDataFrame([], DIM_CUSTOMERS)


def load(spark, *rows):
    return dims.scd2_apply(empty_dim(spark), customers(spark, *rows), effective_date=FIRST)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def many(spark, count=500):
    """Batch 1, and batch 2 where every 10th customer changes segment and every 7th city."""
    base = spark.range(1, count + 1).select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("city"),
        F.lit("consumer").alias("segment"),
        F.lit(SIGNUP).alias("signup_date"),
    )
    second = base.withColumns(
        {
            "segment": F.when(F.col("customer_id") % 10 == 0, "enterprise").otherwise(F.col("segment")),
            "city": F.when(F.col("customer_id") % 7 == 0, "moved").otherwise(F.col("city")),
        }
    )
    return conform(base, RAW["customers"]), conform(second, RAW["customers"])


def test_published_history_of_500_customers(spark):
    first, second = many(spark)
    dim = dims.scd2_apply(empty_dim(spark), first, effective_date=FIRST)
    after = dims.scd2_apply(dim, second, effective_date=SECOND).cache()
    assert after.count() == 614
    assert after.where("NOT is_current").count() == 114
    per_key = dims.current(after).groupBy("customer_id").count()
    assert per_key.count() == 500 and per_key.where("count > 1").isEmpty()
    closed = after.where("NOT is_current").select("valid_from", "valid_to").distinct().collect()
    assert [tuple(r) for r in closed] == [(FIRST, SECOND)]


def test_rerun_changes_nothing(spark):
    first, second = many(spark, 70)
    dim = dims.scd2_apply(empty_dim(spark), first, FIRST)
    once = dims.scd2_apply(dim, second, SECOND)
    assert as_set(dims.scd2_apply(once, second, SECOND)) == as_set(once)
    assert dims.scd2_touched(once, second, SECOND).isEmpty()


def test_touched_and_untouched_rows_make_the_dimension(spark):
    first, second = many(spark, 140)
    dim = dims.scd2_apply(empty_dim(spark), first, FIRST)
    touched = dims.scd2_touched(dim, second, SECOND)
    closed = touched.where("NOT is_current").select("customer_id")
    rest = dim.join(closed, "customer_id", "left_anti").select(*dim.columns)
    assert as_set(rest.unionByName(touched)) == as_set(dims.scd2_apply(dim, second, SECOND))


def test_first_load_into_empty_dimension(spark):
    rows = load(spark, (1, "Rome", "consumer"), (2, "Oslo", "pro")).collect()
    assert {r.customer_id for r in rows} == {1, 2}
    assert all(r.is_current and r.valid_from == FIRST and r.valid_to == date(9999, 12, 31) for r in rows)


def test_only_tracked_attributes_count(spark):
    dim = load(spark, (1, "Rome", "consumer"))
    renamed = customers(spark, (1, "Rome", "consumer")).withColumns(
        {"name": F.lit("other"), "signup_date": F.lit(date(2025, 2, 2))}
    )
    assert dims.scd2_detect(dim, renamed, SECOND).isEmpty()
    assert dims.scd2_detect(dim, renamed, SECOND, tracked=["name"]).count() == 1


def test_a_customer_may_return_to_an_earlier_state(spark):
    dim = load(spark, (1, "Rome", "consumer"))
    dim = dims.scd2_apply(dim, customers(spark, (1, "Oslo", "consumer")), effective_date=SECOND)
    dim = dims.scd2_apply(dim, customers(spark, (1, "Rome", "consumer")), effective_date=SECOND)
    assert dim.count() == 3
    assert [r.city for r in dims.current(dim).collect()] == ["Rome"]


def test_repeated_key_in_one_batch_opens_one_row(spark):
    batch = customers(spark, (1, "Rome", "consumer"), (1, "Oslo", "consumer"), (1, "Bonn", "pro"))
    assert dims.scd2_detect(empty_dim(spark), batch, FIRST).count() == 1
    ordered = batch.withColumn("seq", F.when(F.col("city") == "Oslo", 9).otherwise(1))
    newest = dims.scd2_detect(empty_dim(spark), ordered, FIRST, order_by=["seq"]).collect()
    assert [(r.customer_id, r.city) for r in newest] == [(1, "Oslo")]


def test_all_current_rows_of_a_changed_key_close(spark):
    """A dimension that already breaks the one-current-row rule."""
    dim = load(spark, (1, "Rome", "consumer")).unionByName(load(spark, (1, "Oslo", "consumer")))
    same_as_one = customers(spark, (1, "Oslo", "consumer"))
    assert dims.scd2_detect(dim, same_as_one, SECOND).isEmpty()
    assert dims.scd2_close(dim, dims.scd2_detect(dim, same_as_one, SECOND), SECOND).where("is_current").count() == 2
    other = customers(spark, (1, "Bonn", "consumer"))
    assert [r.city for r in dims.current(dims.scd2_apply(dim, other, SECOND)).collect()] == ["Bonn"]


def test_rows_without_a_key_are_kept_and_match_nothing(spark):
    batch = customers(spark, (1, "Rome", "consumer"), (None, "Oslo", "a"), (None, "Oslo", "a"), (None, "Bonn", "b"))
    dim = dims.scd2_apply(empty_dim(spark), batch, FIRST)
    assert dim.count() == 4
    again = dims.scd2_apply(dim, batch, SECOND)
    assert again.count() == 7 and again.where("NOT is_current").isEmpty()


def test_current_flag_null_passes_through_closing(spark):
    dim = load(spark, (1, "Rome", "consumer")).withColumn("is_current", F.lit(None).cast("boolean"))
    assert dims.scd2_apply(dim, customers(spark, (1, "Oslo", "consumer")), SECOND).count() == 2


def test_fingerprint_collisions_and_the_null_safe_mode(spark):
    rows = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None)], "city string, segment string"
    )
    plain = [r[0] for r in rows.select(row_hash(["city", "segment"])).collect()]
    assert plain[0] == plain[1] and plain[2] == plain[3]
    safe = [r[0] for r in rows.select(row_hash(["city", "segment"], null_safe=True)).collect()]
    assert len(set(safe)) == 4
    with pytest.raises(ValueError):
        row_hash([])


def test_fingerprint_is_the_plain_sha256(spark):
    import hashlib

    rows = spark.createDataFrame([("Rome", "consumer")], "city string, segment string")
    expected = hashlib.sha256(b"Rome|consumer").hexdigest()
    assert rows.select(row_hash(["city", "segment"])).first()[0] == expected


def products(spark, *rows):
    return spark.createDataFrame(
        [(i, f"s{i}", name, "cat", "sub", None, None, None) for i, name in rows], RAW["products"]
    )


def test_insert_new_keeps_existing_rows_and_takes_each_new_key_once(spark):
    dim = products(spark, (1, "old"))
    batch = products(spark, (1, "newer"), (2, "b"), (2, "c"), (3, "d"), (None, "x"), (None, "x"))
    added = dims.insert_new(dim, batch)
    assert sorted((r.product_id or 0, r.name) for r in added.collect()) == [(0, "x"), (0, "x"), (2, "c"), (3, "d")]
    assert dims.insert_new(dim.unionByName(added), batch.where("product_id IS NOT NULL")).isEmpty()

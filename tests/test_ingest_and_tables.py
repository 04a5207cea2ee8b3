"""CSV batches, named tables, time travel, compaction and expiry."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from oreline.operators import history
from oreline.schemas import RAW, conform
from oreline.sources import batches, catalog, paths

PAIR = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_scratch_of_a_scope_goes_with_it(spark):
    from oreline.sources import paths

    outside = paths.scratch_path(spark, "outside")
    with paths.scratch_scope(spark):
        kept = paths.stored(spark.range(3), "inside")
        with paths.scratch_scope(spark):
            paths.stored(spark.range(1), "deeper")
        (file,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
        assert paths.path_exists(spark, file) and kept.count() == 3
        kept.write.parquet(outside)
    assert not paths.path_exists(spark, file) and spark.read.parquet(outside).count() == 3
    assert "scope-" not in paths.scratch_path(spark, "after")


def test_batch_naming():
    assert batches.batch_number("/data/batch2/") == 2
    assert batches.batch_number("/data/batch17") == 17
    assert batches.batch_file("/data/batch17", "orders") == "/data/batch17/orders_b17.csv"
    with pytest.raises(ValueError):
        batches.batch_number("/data/batch")


def test_csv_follows_the_declared_schema(spark, tmp_path):
    folder = tmp_path / "batch1"
    folder.mkdir()
    (folder / "products_b1.csv").write_text(
        "product_id,sku,name,category,subcategory,unit_price,cost,launch_date\n"
        '1,S1,"Lamp, large",home,light,5.005,2.50,2026-01-31\n'
        "x,S2,Chair,home,seat,oops,3.10,2026-13-01\n"
    )
    raw = batches.read_batch(spark, str(folder), "products")
    assert raw.schema.fields[:-1] == RAW["products"].fields
    first, second = raw.orderBy("sku").collect()
    assert (first.product_id, first.name, first.unit_price, first.launch_date, first.batch_id) == (
        1, "Lamp, large", D("5.01"), date(2026, 1, 31), 1,
    )
    # fields that do not parse are NULL, the row stays
    assert (second.product_id, second.unit_price, second.launch_date, second.cost) == (None, None, None, D("3.10"))
    assert spark.table("raw_products").count() == 2


def test_missing_batch_directory(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        batches.read_batch(spark, str(tmp_path / "batch9"), "orders")


def test_append_keeps_batches_apart_and_counts_them(spark, tmp_path):
    path = str(tmp_path / "bronze")
    for number, rows in ((1, 3), (2, 2), (2, 2)):
        batches.append_batch(spark.range(rows).withColumn("batch_id", F.lit(number)), path)
    counts = batches.row_counts({"things": spark.read.parquet(path)}).orderBy("batch_id").collect()
    assert [tuple(r) for r in counts] == [("things", 1, 3), ("things", 2, 4)]


def test_conform_fails_on_overflow(spark):
    wide = spark.createDataFrame([(D("123456789012345.00"),)], "amount decimal(20,2)")
    narrow = T.StructType([T.StructField("amount", T.DecimalType(14, 2))])
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        conform(wide, narrow).collect()


# -- history over plain DataFrames --------------------------------------------


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [(2, datetime(2026, 2, 1), "append"), (1, datetime(2026, 1, 1), "append"), (3, datetime(2026, 3, 1), "delete")],
        "snapshot_id long, committed_at timestamp, operation string",
    )


@pytest.fixture(scope="module")
def versioned(spark):
    return spark.createDataFrame(
        [("a", 1, None), ("b", 1, 3), ("c", 2, None), ("d", 2, 2)],
        "v string, added_snapshot long, removed_snapshot long",
    )


def test_history_and_previous(spark, log):
    assert [r.snapshot_id for r in history.snapshot_history(log).collect()] == [1, 2, 3]
    assert history.previous_snapshot(log).first().snapshot_id == 2
    assert history.previous_snapshot(log.where("snapshot_id = 1")).isEmpty()


def test_as_of_each_commit(log, versioned):
    def at(n):
        return sorted(r.v for r in history.as_of(versioned, log, n).collect())

    assert (at(1), at(2), at(3)) == (["a", "b"], ["a", "b", "c"], ["a", "c"])
    assert tuple(history.count_as_of(versioned, log).first()) == (2, 3)
    with pytest.raises(LookupError):
        at(4)
    with pytest.raises(LookupError):
        history.count_as_of(versioned, log.where("snapshot_id = 3"))


@pytest.mark.parametrize("now, days, kept", [
    (datetime(2026, 3, 2), 30, [2, 3]),
    (datetime(2026, 3, 3), 30, [2, 3]),
    (datetime(2026, 3, 4), 30, [3]),
    (datetime(2027, 1, 1), 30, [3]),
    (datetime(2026, 3, 2), 365, [1, 2, 3]),
])
def test_expiry_cutoff(log, now, days, kept):
    ids = sorted(r.snapshot_id for r in history.unexpired(log, now, days).collect())
    assert ids == kept


def test_expired_rows_go_and_remaining_reads_stay(log, versioned):
    kept = history.expire(versioned, log, datetime(2027, 1, 1))
    assert sorted(r.v for r in kept.collect()) == ["a", "c"]
    rest = history.unexpired(log, datetime(2027, 1, 1))
    assert sorted(r.v for r in history.as_of(kept, rest, 3).collect()) == ["a", "c"]
    with pytest.raises(LookupError):
        history.as_of(kept, rest, 2)


def test_compaction_merges_files_and_keeps_rows(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).withColumn("part", F.col("id") % 2).repartition(6).write.partitionBy("part").parquet(many)
    before = spark.read.parquet(many)
    history.compact(before, few, ["part"])
    after = spark.read.parquet(few)
    assert history.file_count(before).first().files == 12
    assert history.file_count(after).first().files == 2
    assert sorted(after.collect()) == sorted(before.collect())


def test_compaction_splits_a_hot_cluster_value(spark, tmp_path):
    """Files are sized by bytes, so one value with most rows does not end in one task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    many = str(tmp_path / "many")
    rows = spark.range(40000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 3).otherwise(0).alias("part"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    rows.repartition(8).write.parquet(many)
    spark.conf.set(key, "200k")
    try:
        out = str(tmp_path / "few")
        history.compact(spark.read.parquet(many), out, ["part"])
    finally:
        spark.conf.unset(key)
    assert history.file_count(spark.read.parquet(out).where("part = 0")).first().files > 3


# -- named tables --------------------------------------------------------------


@pytest.fixture()
def named(spark, tmp_path):
    catalog.create_table(spark, "shelf.t", PAIR, str(tmp_path / "wh"), ["v"])
    catalog.create_table(spark, "shelf.t", PAIR, str(tmp_path / "wh"), ["v"])
    yield "shelf.t"
    spark.sql("DROP SCHEMA shelf CASCADE")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), PAIR)


def pairs(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_insert_is_by_name_and_adds(spark, named):
    catalog.insert(rows(spark, (1, "a"), (2, "b")).select("v", "k"), named)
    catalog.insert(rows(spark, (3, "a")).withColumn("more", F.lit(1)), named)
    assert pairs(spark.table(named)) == [(1, "a"), (2, "b"), (3, "a")]


def test_insert_refuses_what_does_not_fit(spark, named):
    with pytest.raises(AnalysisException):
        catalog.insert(rows(spark, (1, "a")).drop("v"), named)
    with pytest.raises(AnalysisException):
        catalog.insert(rows(spark, (1, "a")).withColumn("k", F.lit("text")), named)
    assert spark.table(named).isEmpty()


def test_replaced_partitions_may_read_the_table(spark, named):
    catalog.insert(rows(spark, (1, "a"), (2, "a"), (3, "b")), named)
    catalog.replace_partitions(spark.table(named).where("v = 'a' AND k = 1"), named)
    assert pairs(spark.table(named)) == [(1, "a"), (3, "b")]


def test_stored_reads_back_what_was_written(spark):
    kept = paths.stored(rows(spark, (1, "a")), "pair")
    assert pairs(kept) == [(1, "a")] and kept.schema == PAIR
    assert paths.scratch_root(spark) in kept.inputFiles()[0]

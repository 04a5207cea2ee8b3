"""Checks that share scans, measures taken on the way, and exact bitmaps."""

from __future__ import annotations

from collections import Counter
from datetime import date

import pytest
from hypothesis import given, settings as tries, strategies as st
from pyspark.sql import functions as F

from oreline.operators import bitmaps, dimensions, quality
from oreline.sources.batches import counted
from tests.test_plans import plan

RUN = date(2026, 8, 15)


def suite(table, *checks):
    return {"tables": [{"table": table, "checks": list(checks)}]}


def outcome(df):
    return {r.check_name: (r.passed, r.measured) for r in df.collect()}


def unique(name, *columns):
    return {"name": name, "type": "unique", "columns": list(columns)}


def sql(name, query):
    return {"name": name, "type": "sql", "query": query}


# -- shared scans ------------------------------------------------------------


@pytest.fixture
def stored_rows(spark, tmp_path):
    rows = [(1, "a", None), (1, "a", None), (2, None, 5), (2, None, 6), (3, "b", 5), (None, "b", 7), (None, "c", 7)]
    spark.createDataFrame(rows, "k bigint, t string, `odd name` int").write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_unique_checks_of_a_table_share_one_scan(spark, stored_rows):
    """NULL is a value like any other, and differs from a column that a set leaves out."""
    checks = [
        unique("k", "k"), unique("k_t", "k", "t"), unique("t_k", "T", "K"), unique("name", "odd name"),
        unique("k_again", "k", "K"), unique("all", "k", "t", "odd name"),
    ]
    found = quality.evaluate(spark, {"r": stored_rows}, suite("r", *checks), RUN)
    assert plan(found).count("FileScan") == 1
    alone = {
        c["name"]: outcome(quality.evaluate(spark, {"r": stored_rows}, suite("r", c), RUN))[c["name"]] for c in checks
    }
    assert outcome(found) == alone
    assert outcome(found)["k"] == (False, "3") and outcome(found)["all"] == (False, "1")


def test_unique_checks_fail_apart(spark, stored_rows):
    checks = [unique("k", "k"), unique("gone", "nowhere"), unique("t", "t", "odd name")]
    found = outcome(quality.evaluate(spark, {"r": stored_rows}, suite("r", *checks), RUN))
    assert found == {"k": (False, "3"), "gone": (False, None), "t": (False, "1")} or found["gone"] == (False, None)
    empty = quality.evaluate(spark, {"r": stored_rows.limit(0)}, suite("r", unique("k", "k"), unique("t", "t")), RUN)
    assert outcome(empty) == {"k": (True, "0"), "t": (True, "0")}


def test_sql_checks_that_read_alike_share_a_scan(spark, stored_rows):
    queries = {
        "rows": "SELECT count(*) FROM r",
        "most": "SELECT max(k) - 3 FROM r",
        "least": "SELECT min(t) FROM r -- a comment",
        "two_columns": "SELECT count(t) - 5, 'x' FROM r",
    }
    checks = [sql(n, q) for n, q in queries.items()]
    found = quality.evaluate(spark, {"r": stored_rows}, suite("r", *checks), RUN)
    assert outcome(found) == {
        "rows": (False, "7"), "most": (True, "0"), "least": (False, "a"), "two_columns": (True, "0")
    }
    # Three in one subquery (repeated in the text for each of its uses); Spark leaves the one
    # that is aggregated by sorting to itself.
    text = found._jdf.queryExecution().optimizedPlan().toString()
    subqueries = {line.split("Aggregate ")[1] for line in text.splitlines() if "Aggregate [" in line}
    assert "mergedValue" in text and len(subqueries) == 2


@pytest.mark.parametrize(
    "query, expected",
    [
        ("SELECT k FROM r WHERE false", (False, None)),  # no row
        ("SELECT CAST(NULL AS INT) FROM r LIMIT 1", (False, None)),  # a NULL is not 0
        ("SELECT 0, 1 FROM r", (True, "0")),  # the first row's first cell
        ("WITH c AS (SELECT count(*) n FROM r) SELECT n - 7 FROM c", (True, "0")),
        ("SELECT nothing FROM r", (False, None)),
        ("SHOW TABLES IN nowhere_at_all", (False, None)),
        ("SELECT true FROM r", (False, "True")),
        ("SELECT DATE '2026-01-02' FROM r", (False, "2026-01-02")),
    ],
)
def test_sql_checks_together_as_alone(spark, stored_rows, query, expected):
    beside = sql("beside", "SELECT count(*) - 7 FROM r")
    alone = outcome(quality.evaluate(spark, {"r": stored_rows}, suite("r", sql("q", query)), RUN))
    found = outcome(quality.evaluate(spark, {"r": stored_rows}, suite("r", sql("q", query), beside), RUN))
    assert found["q"] == alone["q"] == expected and found["beside"] == (True, "0")


def test_a_statement_that_is_no_query_runs_by_itself(spark, stored_rows):
    spark.sql("CREATE TABLE IF NOT EXISTS measured_here (x INT) USING parquet")
    try:
        shown = sql("shown", "SHOW COLUMNS IN measured_here")
        found = outcome(quality.evaluate(spark, {"r": stored_rows}, suite("r", shown, sql("q", "SELECT 0 FROM r")), RUN))
        assert found == {"shown": (False, "x"), "q": (True, "0")}
    finally:
        spark.sql("DROP TABLE measured_here")


# -- isolation ---------------------------------------------------------------


def test_failing_checks_are_found_by_halving(spark, stored_rows, monkeypatch):
    """One bad check of 16: the group, then one half of what failed after the other."""
    tried = []
    whole = quality._plan

    def watched(spark, group, tables, run_date):
        tried.append(len(group))
        return whole(spark, group, tables, run_date)

    monkeypatch.setattr(quality, "_plan", watched)
    checks = [sql(f"q{i}", f"SELECT count(*) - 7 + {i} - {i} FROM r") for i in range(16)]
    checks[11] = sql("bad", "SELECT CAST(min(t) AS INT) FROM r")
    found = quality.run_suite(spark, {"r": stored_rows}, suite("r", *checks), RUN)
    rows = found.orderBy("check_no").collect()
    assert [r.check_name for r in rows] == [c["name"] for c in checks]
    assert [r.passed for r in rows] == [i != 11 for i in range(16)]
    assert tried == [16, 8, 8, 4, 2, 1, 1, 2, 4] or len(tried) <= 1 + 2 * 4


def test_tables_run_side_by_side(spark, stored_rows):
    tables = {f"r{i}": stored_rows for i in range(6)}
    both = {"tables": [{"table": n, "checks": [unique("k", "k"), sql("n", f"SELECT count(*) - 7 FROM {n}")]} for n in tables]}
    many, one = (quality.run_suite(spark, tables, both, RUN, at_once=n) for n in (4, 1))
    assert many.orderBy("check_no").collect() == one.orderBy("check_no").collect()
    assert not spark.getTags()


# -- on the way --------------------------------------------------------------


def test_watched_checks_equal_evaluated_ones(spark, stored_rows, tmp_path):
    checks = [
        {"name": "present", "type": "not_null", "column": "t"},
        {"name": "positive", "type": "positive", "column": "odd name"},
        {"name": "rows", "type": "row_count", "min": 1, "max": 6, "severity": "warn"},
        {"name": "named", "type": "in_set", "column": "t", "values": ["a", "b"]},
        {"name": "gone", "type": "not_null", "column": "nowhere"},
        unique("k", "k"),
    ]
    for rows in (stored_rows, stored_rows.limit(0)):
        watched = quality.watch(rows, "r", suite("r", *checks), RUN)
        watched.rows.write.mode("overwrite").parquet(str(tmp_path / "copy"))
        expected = quality.evaluate(spark, {"r": rows}, suite("r", *checks), RUN).where("check_type != 'unique'")
        assert sorted(watched.results().collect()) == sorted(expected.collect())
        assert spark.read.parquet(str(tmp_path / "copy")).count() == rows.count()


def test_nothing_to_watch(spark, stored_rows):
    assert quality.watch(stored_rows, "r", suite("other", unique("k", "k")), RUN).results().collect() == []


def test_rows_are_counted_as_they_are_written(spark, stored_rows, tmp_path):
    rows, written = counted(stored_rows)
    rows.write.parquet(str(tmp_path / "copy"))
    assert written() == 7


# -- frozen change sets ------------------------------------------------------


def test_a_source_that_changes_between_two_reads(spark):
    """Every read of the batch gives other attributes and other customers."""
    first = spark.range(2000).select(
        F.col("id").alias("customer_id"), F.lit("n").alias("name"), F.lit("Rome").alias("city"), F.lit("s").alias("segment"),
        F.lit(date(2025, 1, 1)).alias("signup_date"),
    )
    dim = dimensions.scd2_open(first, date(2026, 1, 1))
    draw = F.udf(lambda _: __import__("random").random(), "double").asNondeterministic()
    moving = first.where(draw("customer_id") < 0.5).withColumn("city", F.lit("Oslo"))
    after = dimensions.scd2_apply_frozen(dim, moving, date(2026, 2, 1))
    states = Counter((r.customer_id, r.is_current) for r in after.collect())
    assert all(states[i, True] == 1 for i in range(2000))
    closed = {i for i, current in states if not current}
    assert 800 < len(closed) < 1200
    # One state: asked again, it is the same.
    assert Counter((r.customer_id, r.is_current) for r in after.collect()) == states


def test_frozen_equals_lazy(spark):
    rows = "customer_id bigint, name string, city string, segment string, signup_date date, batch_id int"
    dim = dimensions.scd2_open(
        spark.createDataFrame([(1, "a", "x", "s", None, 1), (2, "b", "x", None, None, 1), (None, "c", "x", "s", None, 1)], rows).drop("batch_id"),
        date(2026, 1, 1),
    )
    batch = spark.createDataFrame(
        [(1, "a", "x", "s", None, 2), (2, "b", "y", "s", None, 2), (2, "b", "z", "s", None, 3), (3, "d", "x", "s", None, 2), (None, "e", "x", "s", None, 2)],
        rows,
    )
    args = dim, batch, date(2026, 2, 1)
    lazy, frozen = (f(*args, order_by=["batch_id"]) for f in (dimensions.scd2_apply, dimensions.scd2_apply_frozen))
    assert sorted(map(str, lazy.collect())) == sorted(map(str, frozen.collect()))


# -- bitmaps -----------------------------------------------------------------

KEYS = st.integers(-(2**63) + 1, 2**63 - 1) | st.integers(-70_000, 70_000) | st.none()


@given(st.lists(st.tuples(st.sampled_from("ab"), KEYS), max_size=30), st.lists(st.tuples(st.sampled_from("bc"), KEYS), max_size=30))
@tries(max_examples=8, deadline=None)
def test_sets_of_two_batches_add_up(spark, first, second):
    frames = [spark.createDataFrame(r, "g string, k bigint") for r in (first, second)]
    states = [bitmaps.key_sets(f, ["g"], "k") for f in frames]
    found = {r.g: r.n for r in bitmaps.distinct_counts(bitmaps.united(states, ["g"]), ["g"], "n").collect()}
    expected = {g: len({k for h, k in first + second if h == g and k is not None}) for g in "abc"}
    assert found == {g: n for g, n in expected.items() if n}
    a, b = (bitmaps.key_sets(f, [], "k") for f in frames)
    keys = [{k for _, k in r if k is not None} for r in (first, second)]
    assert bitmaps.missing(a, b).first().missing == len(keys[0] - keys[1])


def test_bitmaps_are_of_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        bitmaps.key_sets(spark.createDataFrame([("x",)], "k string"), [], "k")


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    text = plan(bitmaps.key_sets(rows, [], "k"))
    assert text.index("Aggregate") < text.index("Exchange") and "partial_bitmap_construct_agg" in text

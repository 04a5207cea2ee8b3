"""Slowly changing dimensions.

Type 2: every change of a tracked attribute closes the current row of its key and
opens a new one.  Type 0: a key is inserted once and never changes.

Parquet has no row-level update, so the Type 2 steps are expressions over whole
DataFrames.  The change set is one immutable plan that the closing and the opening
both read, which makes a second run with the same batch a no-op.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions import row_hash
from oreline.operators.absent import absent_from
from oreline.sources.paths import stored

# Fixed value: the open end of a current row.
OPEN_END = date(9999, 12, 31)

CUSTOMER_KEY = ("customer_id",)
CUSTOMER_TRACKED = ("city", "segment")
PRODUCT_KEY = ("product_id",)


def _keyed(key: Sequence[str]) -> Column:
    """Every key column has a value.  A NULL identifies nothing and never matches."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in key])


def latest_per_key(rows: DataFrame, key: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``order_by`` per key; the other columns break ties.

    An aggregate rather than a window: each map task forwards one row per key, so
    copies of a hot key never meet in one task.  Rows without a key are left out.
    """
    key, rest = list(key), [c for c in rows.columns if c not in key]
    rank = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order_by)]
    newest = F.max(F.struct(*rank, *[F.col(c) for c in rest], F.lit(0).alias("_end")))
    return (
        rows.where(_keyed(key))
        .groupBy(*key)
        .agg(newest.alias("_row"))
        .select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in rows.columns])
    )


def scd2_open(
    rows: DataFrame,
    effective_date: date,
    tracked: Sequence[str] = CUSTOMER_TRACKED,
    null_safe: bool = False,
) -> DataFrame:
    """``rows`` as current dimension rows: validity, flag and fingerprint added."""
    return rows.select(
        *rows.columns,
        F.lit(effective_date).cast("date").alias("valid_from"),
        F.lit(OPEN_END).cast("date").alias("valid_to"),
        F.lit(True).alias("is_current"),
        row_hash(tracked, null_safe).alias("hash_value"),
    )


def _changed_keys(
    dim: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    effective_date: date,
    order_by: Sequence[str],
    null_safe: bool,
) -> DataFrame:
    """Rows to open for keys that are new or changed; each key once."""
    key = list(key)
    business = [c for c in dim.columns if c in incoming.columns]
    states = latest_per_key(incoming, key, order_by).select(*business)
    opened = scd2_open(states, effective_date, tracked, null_safe).select(*dim.columns).alias("new")
    known = (
        current(dim)
        .select(*key, "hash_value")
        .join(incoming.select(*key).distinct(), key, "left_semi")
        .alias("old")
    )
    same_key = [F.col(f"new.{c}") == F.col(f"old.{c}") for c in key]
    # Not a bare equality, which Spark would make a second partitioning key: all steps
    # then share the partitioning by business key that the aggregate above set up.
    same_state = F.coalesce(F.col("new.hash_value") == F.col("old.hash_value"), F.lit(False))
    return opened.join(known, reduce(Column.__and__, same_key) & same_state, "left_anti")


def _keyless(
    dim: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    effective_date: date,
    null_safe: bool,
) -> DataFrame:
    """Rows to open because they have no key to match by."""
    rows = incoming.where(~_keyed(key))
    return scd2_open(rows, effective_date, tracked, null_safe).select(*dim.columns)


def scd2_detect(
    dim: DataFrame,
    incoming: DataFrame,
    effective_date: date,
    key: Sequence[str] = CUSTOMER_KEY,
    tracked: Sequence[str] = CUSTOMER_TRACKED,
    order_by: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """New and changed keys of ``incoming``, as the rows to open.

    A key is unchanged when a current row has both its key and its fingerprint.  Only
    ``tracked`` columns count as a change.  ``order_by`` picks the newest row when a
    batch repeats a key; columns that the dimension lacks serve that order only.  Rows
    without a key match nothing, so each is opened.
    """
    changes = _changed_keys(dim, incoming, key, tracked, effective_date, order_by, null_safe)
    return changes.unionByName(_keyless(dim, incoming, key, tracked, effective_date, null_safe))


def scd2_close(
    dim: DataFrame,
    changes: DataFrame,
    effective_date: date,
    key: Sequence[str] = CUSTOMER_KEY,
) -> DataFrame:
    """All rows of ``dim``; current ones whose key is in ``changes`` end at the date.

    Only current rows with a key take part in the join; closed history passes by.
    ``changes`` must hold a key at most once, as ``scd2_detect`` does.
    """
    key = list(key)
    open_now = F.coalesce(F.col("is_current"), F.lit(False)) & _keyed(key)
    changed = changes.where(_keyed(key)).select(*key, F.lit(True).alias("_changed"))
    marked = current(dim).where(_keyed(key)).join(changed, key, "left")
    closing = F.col("_changed").isNotNull()
    now = marked.select(
        *[
            {
                "valid_to": F.when(closing, F.lit(effective_date)).otherwise(F.col("valid_to")),
                "is_current": ~closing,
            }.get(c, F.col(c)).alias(c)
            for c in dim.columns
        ]
    )
    return dim.where(~open_now).unionByName(now)


def scd2_apply(
    dim: DataFrame,
    incoming: DataFrame,
    effective_date: date,
    key: Sequence[str] = CUSTOMER_KEY,
    tracked: Sequence[str] = CUSTOMER_TRACKED,
    order_by: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """The whole dimension after ``incoming``: detect, close, open."""
    changes = _changed_keys(dim, incoming, key, tracked, effective_date, order_by, null_safe)
    keyless = _keyless(dim, incoming, key, tracked, effective_date, null_safe)
    return scd2_close(dim, changes, effective_date, key).unionByName(changes).unionByName(keyless)


def scd2_apply_frozen(
    dim: DataFrame,
    incoming: DataFrame,
    effective_date: date,
    key: Sequence[str] = CUSTOMER_KEY,
    tracked: Sequence[str] = CUSTOMER_TRACKED,
    order_by: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """``scd2_apply`` with the change set written to shared storage before it is used (a job).

    Closing and opening then see the same changes, whatever the source of ``incoming`` gives when
    it is read again: a table that grows meanwhile, a sample, a rank among ties.  The change set
    is computed once and outlives lost executors.
    """
    changes = stored(scd2_detect(dim, incoming, effective_date, key, tracked, order_by, null_safe), "changes")
    return scd2_close(dim, changes, effective_date, key).unionByName(changes)


def scd2_touched(
    dim: DataFrame,
    incoming: DataFrame,
    effective_date: date,
    key: Sequence[str] = CUSTOMER_KEY,
    tracked: Sequence[str] = CUSTOMER_TRACKED,
    order_by: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """Only what ``incoming`` changes: the rows it closes, as closed, and those it opens.

    ``scd2_apply`` is these and the rows of ``dim`` whose key is not closed here.  All reads
    are of current rows: of a dimension partitioned by ``is_current`` history is not opened.
    """
    changes = _changed_keys(dim, incoming, key, tracked, effective_date, order_by, null_safe)
    keyless = _keyless(dim, incoming, key, tracked, effective_date, null_safe)
    closing = current(dim).where(_keyed(key)).join(changes.select(*key), list(key), "left_semi")
    closed = closing.withColumns(
        {"valid_to": F.lit(effective_date).cast("date"), "is_current": F.lit(False)}
    )
    return closed.select(*dim.columns).unionByName(changes).unionByName(keyless)


def current(dim: DataFrame) -> DataFrame:
    return dim.where(F.col("is_current"))


def insert_new(
    dim: DataFrame,
    incoming: DataFrame,
    key: Sequence[str] = PRODUCT_KEY,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``incoming`` to add to a Type 0 dimension: absent keys, one row each, and
    the rows without a key, which match nothing."""
    known = dim.select(*key).join(incoming.select(*key).distinct(), list(key), "left_semi")
    added = absent_from(known, latest_per_key(incoming, key, order_by), key)
    return added.unionByName(incoming.where(~_keyed(key))).select(*dim.columns)

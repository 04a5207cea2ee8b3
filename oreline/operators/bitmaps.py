"""Exact sets of integer keys as bitmaps, for distinct counts and membership.

A state has one row per group and bucket of 32,768 consecutive keys: ``bucket`` and 4 KB of
``bits``.  Keys are set in the map tasks and states are united bit by bit, so what is shuffled
and stored follows the range of the keys and not the number of rows, a key in a third of all
rows counts once per task, and the states of two batches add up to the state of both, which
counts of distinct values do not.

Made for dense keys (sequence numbers, surrogate keys) in few groups: a bucket takes 4 KB
however few keys it has.  Above about 250 keys per group and bucket bitmaps are smaller than a
shuffle of distinct 8-byte keys and their group, below it they are larger; ``marts`` therefore
keeps its own distinct counts for the daily grain, and for keys that are no integers.
NULL keys belong to no set.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T


def key_sets(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The state of ``rows``: the set of ``key`` values per group ``by``."""
    kind = rows.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"bitmaps are of integers, {key} is {kind.simpleString()}")
    value = F.col(f"`{key}`").cast("bigint")
    return (
        rows.where(value.isNotNull())
        .groupBy(*by, F.bitmap_bucket_number(value).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    )


def united(states: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """The state of all rows behind several states."""
    together = reduce(DataFrame.unionByName, states)
    return together.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Number of keys per group; groups without a key are not in the state."""
    return state.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def missing(state: DataFrame, known: DataFrame) -> DataFrame:
    """One row with ``missing``: how many keys of ``state`` are not in ``known``.

    Keys of both less keys of the one, bucket by bucket: two states are grouped, rows are not
    joined."""
    both = state.select("bucket", "bits", F.lit(None).cast("binary").alias("known")).unionByName(
        known.select("bucket", "bits", F.col("bits").alias("known"))
    )
    here = both.groupBy("bucket").agg(
        (F.bitmap_count(F.bitmap_or_agg("bits")) - F.bitmap_count(F.bitmap_or_agg("known"))).alias("more")
    )
    return here.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("missing"))

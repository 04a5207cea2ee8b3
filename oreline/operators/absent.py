"""Rows that a target does not hold yet.

Keys match by plain equality: a NULL never equals anything, so rows with a NULL key
always count as absent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def absent_from(target: DataFrame, rows: DataFrame, grain: Sequence[str]) -> DataFrame:
    """``rows`` whose ``grain`` has no equal in ``target``.

    Meant for ``rows`` already unique on the grain, such as an aggregate.  Where the
    target is small enough to broadcast, Catalyst moves the anti-join below that
    aggregate, and only rows of new grains are shuffled at all.
    """
    grain = list(grain)
    return rows.join(target.select(*grain), grain, "left_anti").select(*rows.columns)


def keys_shared(target: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The distinct ``on`` values that occur both in ``target`` and in ``rows``.

    Reduces a long history to what a batch can meet.  A small batch is broadcast to
    the scan of the history, which then needs no shuffle; a large one meets keys that
    both sides have deduplicated before their shuffle, so a key repeated in a third of
    all rows arrives once per map task.
    """
    on = list(on)
    return target.select(*on).distinct().join(rows.select(*on).distinct(), on, "left_semi")


def join_afresh(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, step: int) -> DataFrame:
    """Equi-join that shuffles both sides even where one is already partitioned by ``on``.

    Adaptive execution splits a skewed key only when a sort-merge join reads two plain
    shuffles.  A second join on the same key reuses the first one's partitioning and
    would put all rows of a hot key into one task.  Joining on a bit of the key's hash as
    well (a different one per ``step``) leaves the result as it is, restores the
    plain shuffles, and costs one more pass of the narrower side.  (It rests on the
    default that co-partitioning needs all join keys; without it only the split is lost.)
    """
    on = list(on)
    # One bit is enough to make it a key; a whole hash would be the widest thing to shuffle.
    spread = F.xxhash64(F.lit(step), *[F.col(c) for c in on]).bitwiseAND(F.lit(1))
    joined = left.withColumn("_spread", spread).join(
        right.withColumn("_spread", spread), [*on, "_spread"], how
    )
    return joined.drop("_spread")

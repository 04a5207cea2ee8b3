"""Table history as ordinary DataFrames.

A versioned DataFrame carries ``added_snapshot`` and, where the row has been taken
out since, ``removed_snapshot``.  A snapshot DataFrame lists the commits:
``snapshot_id``, ``committed_at``, ``operation``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("committed_at", "snapshot_id", "operation").orderBy(
        "committed_at", "snapshot_id"
    )


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """The commit before the newest one; no row where there are fewer than two."""
    return (
        snapshots.select("snapshot_id", "committed_at")
        .orderBy(F.desc("committed_at"), F.desc("snapshot_id"))
        .offset(1)
        .limit(1)
        .select("snapshot_id")
    )


def as_of(versioned: DataFrame, snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """The rows the table held after commit ``snapshot_id``.

    Looks the id up first (a one-row job) and raises ``LookupError`` for an unknown or
    expired one.  Where ``added_snapshot`` is a partition column, later commits are
    skipped without opening their files.
    """
    if snapshots.where(F.col("snapshot_id") == snapshot_id).isEmpty():
        raise LookupError(f"snapshot {snapshot_id} is unknown or expired")
    return alive_at(versioned, snapshot_id)


def alive_at(versioned: DataFrame, snapshot_id: int) -> DataFrame:
    """``as_of`` for an id known to be valid; runs nothing."""
    added, removed = F.col("added_snapshot"), F.col("removed_snapshot")
    alive = (added <= snapshot_id) & (removed.isNull() | (removed > snapshot_id))
    return versioned.where(alive).drop("added_snapshot", "removed_snapshot")


def count_as_of(versioned: DataFrame, snapshots: DataFrame, snapshot_id: int | None = None) -> DataFrame:
    """Row count at ``snapshot_id``, by default the previous snapshot.

    Raises ``LookupError`` when asked for the previous of fewer than two snapshots.  Either
    way one job finds the id; the count itself is left to the caller.
    """
    if snapshot_id is None:
        found = previous_snapshot(snapshots).first()
        if found is None:
            raise LookupError("time travel to the previous snapshot needs two snapshots")
        snapshot_id = found.snapshot_id
        rows = alive_at(versioned, snapshot_id)
    else:
        rows = as_of(versioned, snapshots, snapshot_id)
    return rows.agg(F.count(F.lit(1)).alias("rows_at_snapshot")).select(
        F.lit(snapshot_id).cast("long").alias("snapshot_id"), "rows_at_snapshot"
    )


def compacted(rows: DataFrame, cluster_by: Sequence[str] = ()) -> DataFrame:
    """``rows`` regrouped so that writing them yields few, evenly sized files.

    A rebalance, not a repartition: adaptive execution merges small partitions and
    splits large ones towards ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so a
    ``cluster_by`` value with a third of the rows becomes many files, not one task.
    """
    return rows.hint("rebalance", *[F.col(c) for c in cluster_by])


def compact(source: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Rewrite ``source`` to a new ``path`` in few files (runs the write)."""
    compacted(source, partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def file_count(stored: DataFrame) -> DataFrame:
    """Number of files behind a file-based DataFrame that hold rows."""
    return stored.agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"))


def unexpired(snapshots: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Commits at most ``days`` old, and the newest whatever its age."""
    cutoff = F.lit(now - timedelta(days=days))
    newest = snapshots.select("snapshot_id", "committed_at").orderBy(
        F.desc("committed_at"), F.desc("snapshot_id")
    ).limit(1)
    kept_by_age = snapshots.where(F.col("committed_at") >= cutoff)
    kept_anyway = snapshots.where(F.col("committed_at") < cutoff).join(
        newest.select("snapshot_id"), "snapshot_id", "left_semi"
    ).select(*snapshots.columns)
    return kept_by_age.unionByName(kept_anyway)


def expire(versioned: DataFrame, snapshots: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """The stored rows some unexpired commit still shows.

    A row removed at or before the oldest commit kept is visible in none of them.
    Finds that commit first (a one-row job), so the rest is a plain filter.
    """
    oldest = unexpired(snapshots, now, days).agg(F.min("snapshot_id").alias("id")).first().id
    if oldest is None:
        return versioned
    removed = F.col("removed_snapshot")
    return versioned.where(removed.isNull() | (removed > oldest))

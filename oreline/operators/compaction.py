"""Compaction of a stored history, recorded as a commit of its own.

A stored history is a folder with ``rows`` (parquet, partitioned by ``pack`` and
``added_snapshot``) and ``log`` (the commits).  Rows arrive in pack 0.  A compaction writes
copies of rows in small files to a pack numbered like its commit, and only then its log entry,
operation ``replace``, with the names of the files it stands for.  Readers take the packs of the
log and leave out replaced files, so a compaction that failed half-way is invisible, readers of
older commits see the same rows, and replaced files can be deleted at any later time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from oreline.sources.paths import delete_path, path_exists

LOG = "snapshot_id BIGINT, committed_at TIMESTAMP_NTZ, operation STRING, replaced ARRAY<STRING>"
# A file below this share of the target counts as small.
SMALL = 0.75


def write_history(rows: DataFrame, log: DataFrame, path: str) -> None:
    """``rows`` with ``added_snapshot`` and ``removed_snapshot`` and the commits behind them."""
    packed = rows.withColumn("pack", F.lit(0).cast("bigint"))
    packed.write.partitionBy("pack", "added_snapshot").parquet(f"{path}/rows")
    entries = log.select("snapshot_id", F.col("committed_at").cast("timestamp_ntz"), "operation")
    none = F.lit(None).cast("array<string>").alias("replaced")
    entries.select("*", none).coalesce(1).write.parquet(f"{path}/log")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot_id, committed_at, operation`` of all commits, compactions among them."""
    return spark.read.schema(LOG).parquet(f"{path}/log").drop("replaced")


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The versioned rows under their ``schema``, whatever files hold them now."""
    rows, names = _live(spark, path, schema)
    return rows.select(*names)


def _live(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[str]]:
    rows = spark.read.schema(f"{schema}, pack BIGINT").parquet(f"{path}/rows")
    names = [c for c in rows.columns if c != "pack"]
    log = spark.read.schema(LOG).parquet(f"{path}/log").where("operation = 'replace'")
    packs = [0, *(r["snapshot_id"] for r in log.select("snapshot_id").collect())]
    rows = rows.where(F.col("pack").isin(packs)).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    if len(packs) > 1:
        # Before any replacement there is nothing to leave out, and no join.
        gone = log.select(F.explode("replaced").alias("file"))
        rows = rows.join(gone, "file", "left_anti")
    return rows, names


def live_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, bytes, rows, added_snapshot`` of every file that holds rows now.  Reads footers
    and partition names, no column."""
    rows, _ = _live(spark, path, schema)
    return rows.groupBy("file", "added_snapshot").agg(
        F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def bins(files: DataFrame, target: int) -> DataFrame:
    """Small ``files`` of one commit packed in order of their names into ``bin``s of about
    ``target`` bytes; those that are alone in a bin are left out, and so are large files."""
    place = Window.partitionBy("added_snapshot").orderBy("file")
    before = F.coalesce(F.sum("bytes").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    packed = files.where(F.col("bytes") < SMALL * target).withColumn("bin", F.floor(before / target))
    together = F.count("*").over(Window.partitionBy("added_snapshot", "bin"))
    return packed.withColumn("together", together).where("together > 1").drop("together")


def compact_small(
    spark: SparkSession, path: str, schema: str, target: int, now: datetime, most: int = 10_000
) -> DataFrame:
    """Rewrite small files into files of about ``target`` bytes; returns what was done:
    ``snapshot_id, files_replaced, rows_moved``, one row per commit.

    Large files are neither read nor written.  A commit replaces at most ``most`` files, whose
    names pass through the driver and are all that is opened; if there are more, commits follow.
    """
    done, more = [], True
    while more:
        chosen = bins(live_files(spark, path, schema), target).orderBy("added_snapshot", "bin", "file")
        found = chosen.limit(most + 1).collect()
        more = len(found) > most
        if more:
            # A bin that the limit cuts waits for the next commit, unless it is longer than that.
            last = (found[-1]["added_snapshot"], found[-1]["bin"])
            found = [r for r in found if (r["added_snapshot"], r["bin"]) != last] or found[:most]
        if found:
            number = (read_log(spark, path).agg(F.max("snapshot_id").alias("id")).first()["id"] or 0) + 1
            _replace(spark, path, schema, found, number, now)
            done.append((number, len(found), sum(r["rows"] for r in found)))
    return spark.createDataFrame(done, "snapshot_id BIGINT, files_replaced BIGINT, rows_moved BIGINT")


def _replace(spark: SparkSession, path: str, schema: str, found: list, number: int, now: datetime) -> None:
    """One file per bin in pack ``number``, then the log entry that makes it count."""
    pack = f"{path}/rows/pack={number}"
    if path_exists(spark, pack):
        delete_path(spark, pack)  # left by a compaction that was not committed
    names = [r["file"] for r in found]
    rows = spark.read.option("basePath", f"{path}/rows").schema(f"{schema}, pack BIGINT").parquet(*names)
    # At most ``most`` names; every bin is about as large as a file is to be.
    into = spark.createDataFrame([(r["file"], r["bin"]) for r in found], "file STRING, bin BIGINT")
    moved = rows.withColumn("file", F.col("_metadata.file_path")).join(F.broadcast(into), "file")
    count = len({(r["added_snapshot"], r["bin"]) for r in found})
    moved = moved.repartition(count, "added_snapshot", "bin").drop("file", "bin", "pack")
    moved.write.partitionBy("added_snapshot").parquet(pack)
    entry = spark.createDataFrame([(number, now, "replace", names)], LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/log")


def delete_replaced(spark: SparkSession, path: str) -> int:
    """Delete files that a committed compaction stands for; returns how many there were."""
    log = spark.read.schema(LOG).parquet(f"{path}/log").where("operation = 'replace'")
    done = 0
    for commit in log.select("snapshot_id").collect():
        # A commit names at most as many files as one replacement takes.
        names = log.where(F.col("snapshot_id") == commit["snapshot_id"]).select(F.explode("replaced").alias("file"))
        done += sum(delete_path(spark, r["file"]) for r in names.collect())
    return done

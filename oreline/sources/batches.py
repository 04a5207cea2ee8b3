"""Raw CSV batches: a directory per batch, one headed file per entity."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from oreline.schemas import RAW
from oreline.sources.paths import path_exists


def batch_number(batch_dir: str) -> int:
    digits = re.search(r"(\d+)/*$", str(batch_dir))
    if digits is None:
        raise ValueError(f"no batch number at the end of {batch_dir!r}")
    return int(digits.group(1))


def batch_file(batch_dir: str, entity: str) -> str:
    """``<dir>/batch2`` holds ``customers_b2.csv`` and so on; each may also be a folder of parts."""
    return f"{str(batch_dir).rstrip('/')}/{entity}_b{batch_number(batch_dir)}.csv"


def read_csv(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Headed CSV under the declared schema; a field that does not parse becomes NULL."""
    return spark.read.option("header", True).schema(RAW[entity]).csv(path)


def read_batch(spark: SparkSession, batch_dir: str, entity: str) -> DataFrame:
    """One entity of one batch, also registered as the temp view ``raw_<entity>``."""
    if not path_exists(spark, str(batch_dir)):
        raise FileNotFoundError(f"missing raw batch directory: {batch_dir}")
    raw = read_csv(spark, batch_file(batch_dir, entity), entity)
    raw.createOrReplaceTempView(f"raw_{entity}")
    return raw.withColumn("batch_id", F.lit(batch_number(batch_dir)))


def append_batch(batch: DataFrame, path: str) -> None:
    """Create the parquet table at ``path`` or add to it, one directory per batch."""
    batch.write.mode("append").partitionBy("batch_id").parquet(path)


def counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``rows`` to be written once, and how many there were, to be asked for afterwards."""
    observation = Observation()
    watched = rows.observe(observation, F.count(F.lit(1)).alias("rows"))
    return watched, lambda: observation.get["rows"]


def row_counts(batches: dict[str, DataFrame]) -> DataFrame:
    """Rows per entity and batch.  Only the partition column is read."""
    counts = [
        df.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(entity).alias("entity"), "batch_id", "row_count")
        for entity, df in batches.items()
    ]
    return reduce(DataFrame.unionByName, counts)

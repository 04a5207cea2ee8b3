"""Shared helpers: reading the test tables, ASCII normalisation, polynomial hashing."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Columns and types of the test tables.
TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table under its declared schema, so that no job reads footers first."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[named(c) for c in docs.columns])


def named(column: str) -> Column:
    """A column by its exact name, also with dots, blanks or back quotes in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def swept(
    values: Column,
    state: dict[str, Column],
    step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]],
    kind: str,
    end: Callable[[Column, Column], Column] = lambda out, state: out,
    block: int = 256,
) -> Column:
    """An array of SQL type ``kind`` made in one pass over ``values``.

    ``step(state, value)`` gives the new state, an array and whether to append it.  Spark copies
    an aggregation's whole state in every step, so what is made is held per block of values, and
    only between blocks with all that was made before."""
    none = F.array().cast(kind)

    def held(fields: dict[str, Column], part: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in fields.items()], part.alias("_part"))

    def one(at: Column, value: Column) -> Column:
        fields, made, wanted = step(at, value)
        return held(fields, F.when(wanted, F.concat(at["_part"], made)).otherwise(at["_part"]))

    def many(whole: Column, values: Column) -> Column:
        start = held({k: whole["_at"][k] for k in state}, none)
        return F.struct(
            F.aggregate(values, start, one).alias("_at"),
            F.concat(whole["_out"], whole["_at"]["_part"]).alias("_out"),
        )

    def all_of(values: Column) -> Column:
        count = F.ceil(F.size(values) / block).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(values, i * block + 1, F.lit(block))
        )
        start = F.struct(held(state, none).alias("_at"), none.alias("_out"))
        return F.aggregate(
            blocks, start, many, lambda whole: end(F.concat(whole["_out"], whole["_at"]["_part"]), whole["_at"])
        )

    # A lambda's argument is worked out once, an expression wherever it stands.
    return F.transform(F.array(values), all_of)[0]


# Byte tables: ASCII lower-casing alone, and with ASCII other than letters and digits blanked.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in (LOWER[i] for i in range(256))
)
# [\x20\x09-\x0D] blanked, the rest lower-cased.
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else LOWER[b] for b in range(256))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value, a null as none, without decoding."""
    column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Polynomial:
    """Hashes of any substrings of a byte string from one prefix sum (mod 2**64)."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self._byte = draw.integers(1, 2**63, 256, dtype=np.uint64)
        base = int(draw.integers(2**61, 2**63)) * 2 + 1
        self._base, self._inverse = base & (2**64 - 1), pow(base, -1, 2**64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self._up) < n:
            step = len(self._up)
            for name, base in (("_up", self._base), ("_down", self._inverse)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(base, step, 2**64))]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._byte[data] * self._up[: len(data)], out=sums[1:])
        return sums

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(np.uint64))

    def fixed(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(prefix) - length
        return mix((prefix[length:] - prefix[:n]) * self._down[:n])


def arrow_stream(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a task's batches into dicts of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        for out in fn(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays(
                [
                    c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for f, c in ((f, out[f.name]) for f in target)
                ],
                schema=target,
            )
            del out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory returns to the system, so that a worker that goes on to other tasks (Spark
    keeps it) stays small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, object]],
    schema: str | StructType,
    rows: int | None = None,
) -> DataFrame:
    """``arrow_stream`` where ``fn`` turns one batch into one dict, at most ``rows`` at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows):
                yield fn(batch.slice(at, rows))

    return arrow_stream(df, run, schema)

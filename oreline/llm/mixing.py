"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of ``block_words``.
The mix consists of shards of ``shard_slots`` block slots.  Each shard draws how many of its
slots go to which source: multinomial draws, conditioned on the totals that the targets fix
(halving the shards again and again, a multivariate hypergeometric draw per half, so every
shard finds its own counts and those before it from a few draws).  The slots of a source are
numbered through all shards and mapped to its blocks by a pseudorandom permutation of the
block numbers, a new one for each pass over the source; block and slot meet by a join on
(source, block).

Targets: sources by code point, null last, have the weights in turn and share all words; a
target stops at ``most`` times its source's size, and the excess is shared by weight again.

Everything after the word count works on narrow rows.  A hot source is dealt to ``spread``
ordered runs by a hash of the id, so no task holds all its rows; block numbers spread its
slots.  What reaches the driver is one row per source.

A null text has no words; null or repeated ids each give a row, and a null source is a source.
Reruns on the same rows agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from oreline.llm.common import give_back, mix, named, texts, whole_row
from oreline.sources.paths import stored

# The weights in turn.
WEIGHTS = (5, 2, 1)
# Populations that numpy draws from.
NUMPY_LIMIT = 10**9


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(rows: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """``number, source, source_size, target`` per source of ``rows`` (``source, size``).

    Filling up: in order of how early a source's cap stops it, all before are full, and the
    rest share what is left by weight."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("number", number).withColumn(
        "weight", F.get(listed, (F.col("number") % len(weights)).cast("int")).cast("bigint")
    )
    cap = F.col("source_size") * most
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ).cast("double") / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    stops = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("order", "level"))).over(whole)
    filled = (
        sources.withColumn("cap", cap)
        .withColumns({"level": level, "order": F.row_number().over(filling)})
        .withColumn("stop", stops)
    )
    target = F.when(F.col("order") < F.col("stop.order"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("stop.level")
    )
    return filled.select("number", "source", "source_size", target.alias("target"))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)``: a Feistel network, walked until inside."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % 2**62) * np.uint64(8))
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        x = left << half | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def hypergeometric(draw: np.random.Generator, have: int, rest: int, take: int) -> int:
    """How many of ``have`` are among ``take`` drawn of ``have + rest``.

    Past numpy's limit by inversion: the probabilities follow from the mode by their exact
    ratios, as far as they differ from 0 in double precision (some standard deviations)."""
    if not have or not take:
        return 0
    if have + rest < NUMPY_LIMIT:
        return int(draw.hypergeometric(have, rest, take))
    low, high = max(0, take - rest), min(have, take)
    mode = min(max((have + 1) * (take + 1) // (have + rest + 2), low), high)
    share = have / (have + rest)
    reach = 40 + int(40 * math.sqrt(take * share * (1 - share)))
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    # p(k + 1) / p(k), upwards from the mode and, inverted, downwards.
    rise = np.cumprod((have - up) * (take - up) / ((up + 1) * (rest - take + up + 1)))
    fall = np.cumprod(down * (rest - take + down) / ((have - down + 1) * (take - down + 1)))
    weight = np.concatenate([fall[::-1], [1.0], rise])
    total = np.cumsum(weight)
    return mode - len(fall) + int(np.searchsorted(total, draw.random() * total[-1], side="right"))


@lru_cache(1 << 12)
def _half(seed: int, low: int, high: int, slots: tuple[int, ...], take: int) -> tuple[int, ...]:
    """The draw of one half of the shards from ``low`` to ``high``; near shards share most."""
    return tuple(_part(np.random.default_rng([seed, low, high]), list(slots), take))


def _part(draw: np.random.Generator, slots: list[int], take: int) -> list[int]:
    """How many of ``take`` slots, drawn without replacement, fall to each source."""
    left, out = sum(slots), []
    for have in slots:
        rest = left - have
        n = hypergeometric(draw, have, rest, take)
        out.append(n)
        left, take = rest, take - n
    return out


def shard_counts(slots: list[int], shards: int, size: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """Per source the slots of one shard, and those of all shards before it."""
    low, high, before, here = 0, shards, [0] * len(slots), list(slots)
    while high - low > 1:
        middle = (low + high) // 2
        first = list(_half(seed, low, high, tuple(here), (middle - low) * size))
        if shard < middle:
            high, here = middle, first
        else:
            low, before = middle, [b + f for b, f in zip(before, first)]
            here = [h - f for h, f in zip(here, first)]
    return here, before


def _slots(spark, sources: list, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``number, block, shard, slot`` for every slot of the mix."""
    blocks, counts = [], []
    for s in sources:
        n = -(-s["source_size"] // block_words)
        passes = int(s["target"] // s["source_size"]) if n else 0
        rest = s["target"] - passes * s["source_size"]
        blocks.append(n)
        counts.append(passes * n + (min(n, round(rest / s["source_size"] * n)) if n else 0))
    shards = max(1, -(-sum(counts) // shard_slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                here, before = shard_counts(counts, shards, shard_slots, shard, seed)
                number = np.repeat(np.arange(len(here), dtype=np.int32), here)
                found = []
                for s, (n, first) in enumerate(zip(here, before)):
                    j = np.arange(first, first + n)
                    turn = j // max(blocks[s], 1)
                    for t in np.unique(turn):
                        found.append(permuted(j[turn == t] - t * blocks[s], blocks[s], seed + 1000003 * s + int(t)))
                block = np.concatenate(found) if found else np.zeros(0, np.int64)
                columns = number, block, np.full(len(block), shard), np.arange(len(block))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "block", "shard", "slot"])

    return spark.range(shards).mapInArrow(run, "number int, block bigint, shard bigint, slot bigint")


def _pieces(rows: DataFrame, block_words: int, shard_slots: int, seed: int, spread: int, weights, most: int):
    """Per source and per piece (the part of a document in one block) how often the mix takes it."""
    spark = rows.sparkSession
    sources = stored(targets(rows, weights, most), "targets")
    slots = _slots(spark, sources.orderBy("number").collect(), block_words, shard_slots, seed)
    uses = slots.groupBy("number", "block").agg(F.count("*").alias("uses"))
    run = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(spread)).cast("int")
    placed = rows.join(
        sources.select("number", F.col("source").alias("s"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).select("row", "doc_id", "size", "number", "source_size", "target", run.alias("run"))
    runs = placed.groupBy("number", "run").agg(F.sum("size").alias("whole"))
    before = F.sum("whole").over(Window.partitionBy("number").orderBy("run")) - F.col("whole")
    runs = runs.select("number", "run", before.alias("before"))
    inside = Window.partitionBy("number", "run").orderBy("doc_id", "size", "row")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(runs, ["number", "run"]).withColumn("start", F.col("before") + F.col("inside"))
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))
    )
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select(
        "row", "doc_id", "size", "source_size", "target", "number", "block",
        (begin - F.col("start")).alias("first"), (end - F.col("start")).alias("last"),
    )
    # The slots come from few rows of shard numbers, by which Spark would judge their size.
    return pieces.join(uses.hint("merge"), ["number", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """The rows with their size, numbered once as written."""
    rows = docs.select(
        named(id_col).alias("doc_id"),
        named(source_col).alias("source"),
        n_words(named(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("row"),
        *more,
    )
    return stored(rows, "sized")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 1,
    spread: int = 128,
    weights=WEIGHTS,
    most: int = 3,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row: the words the mix takes of it."""
    rows = _sized(docs, id_col, text_col, source_col)
    pieces = _pieces(rows, block_words, shard_slots, seed, spread, weights, most)
    words = F.coalesce((F.col("last") - F.col("first")) * F.col("uses"), F.lit(0))
    return (
        pieces.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(words).cast("bigint").alias("taken"))
        .drop("row")
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 1,
    spread: int = 128,
    weights=WEIGHTS,
    most: int = 3,
) -> DataFrame:
    """The mix as rows like those of ``docs``: for each time that words of a row are taken, a
    row whose text is these words, in order and single-spaced."""
    base = _sized(docs, id_col, text_col, source_col, whole_row(docs).alias("whole"))
    pieces = _pieces(base.drop("whole"), block_words, shard_slots, seed, spread, weights, most)
    taken = pieces.where("uses > 0").groupBy("row")
    taken = taken.agg(F.sort_array(F.collect_list(F.struct("first", "last", "uses"))).alias("pieces"))
    rows = base.select("row", "whole").join(taken, "row").select(
        # Without the text, which travels once.
        F.struct(
            *[(F.lit(None).cast("string") if c == text_col else F.col("whole")[c]).alias(c) for c in docs.columns]
        ).alias("whole"),
        F.col("whole")[text_col].alias("text"),
        "pieces",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024))
        for batch in slices:
            at, out = [], []
            lists = batch.column("pieces").to_pylist()
            for i, (text, pieces) in enumerate(zip(texts(batch.column("text")), lists)):
                words = text.translate(_BLANK).split(b" ")
                words = [w for w in words if w]
                for copy in range(max(p["uses"] for p in pieces)):
                    parts = [w for p in pieces if p["uses"] > copy for w in words[p["first"] : p["last"]]]
                    at.append(i)
                    out.append(b" ".join(parts).decode())
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("whole").take(pa.array(at)), pa.array(out)], ["whole", "mixed"]
                )
        give_back()

    found = rows.mapInArrow(run, StructType([rows.schema["whole"], StructField("mixed", StringType())]))
    return found.select(
        *[(F.col("mixed") if c == text_col else F.col("whole")[c]).alias(c) for c in docs.columns]
    )


# [\x20\x09-\x0D] as blanks.
_BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))

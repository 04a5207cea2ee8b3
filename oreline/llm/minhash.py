"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles.  Two permutations of the 32-bit
integers make all signature coordinates: the first places every shingle, the second is
applied after a circular shift by k for coordinate k (Li and Li, 2021).  Bands of the
signature choose candidates, full shingle sets confirm them, and confirmed links make the
components.

How the work stays bounded:

* Documents with equal word sequences form one class; only classes are compared.
* In a bucket every member meets the bucket's smallest member (the pivot), not every other.
* Where that leaves members of one pivot in several components, these members are compared
  exactly, block against block, and only links between components are emitted.  A block
  holds at most ``BLOCK`` sets and ``BLOCK_BYTES`` of them on average, so no task gets a whole
  group or more of long texts than it can hold.
* A link of Jaccard similarity s is missed only if no band agrees, (1 - s**ROWS)**BANDS:
  7e-8 at 0.85, 8e-6 at 0.8.

Nulls and texts without words have an empty set and link with nothing.  Rows without an id,
repeated ids and repeated rows each give a row of the result; a component whose rows all
lack an id has a null id, and ``near_duplicates`` marks those rows as kept.
``without_near_duplicates`` goes by rows, not ids: one row of each component stays, and every
row without words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import SPACED, Polynomial, arrow_map, mix, named, texts, whole_row
from oreline.llm.components import components
from oreline.operators.absent import join_afresh
from oreline.sources.paths import stored

BANDS, ROWS = 28, 5
BLOCK, BLOCK_BYTES = 1024, 1 << 22
# Bytes of a text that are hashed at once.
PIECE = 1 << 18

# The bijections behind the two permutations; odd multipliers, fixed for reruns.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PI = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_POLY = Polynomial(101)
_IS_WORD = np.arange(256) != 32


def words(text: bytes) -> bytes:
    """Lower-cased words joined by single spaces."""
    return b" ".join(text.translate(SPACED).split())


def _word_hashes(sequence: bytes):
    """Hashes of the words, a long sequence piece by piece."""
    at = 0
    while at <= len(sequence):
        end = sequence.find(b" ", at + PIECE)
        data = np.frombuffer(sequence, np.uint8)[at : len(sequence) if end < 0 else end]
        gaps = np.flatnonzero(~_IS_WORD[data])
        start, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        yield _POLY.hashes(_POLY.prefix(data), start, last)
        at = len(sequence) + 1 if end < 0 else end + 1


def shingle_set(sequence: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words(text)``.

    A sequence shorter than ``size`` is one shingle; an empty one has none."""
    if not sequence:
        return np.zeros(0, np.uint64)
    word = np.concatenate(list(_word_hashes(sequence)))
    size = min(size, len(word))
    count = len(word) - size + 1
    out = word[:count]
    for j in range(1, size):
        out = mix(out * _GOLDEN + word[j : count + j])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates from one placement (the high half of the hash) and its shifts."""
    placed = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 2**32 - 1, np.uint32)
    for i in range(0, len(placed), 256):
        x = placed[None, i : i + 256] + _SHIFTS
        x *= _PI[0]
        x ^= x >> np.uint32(15)
        x *= _PI[1]
        x ^= x >> np.uint32(13)
        x *= _PI[2]
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    bands = signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * _GOLDEN + bands[:, j])
    return key.view(np.int64)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _features(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of ``doc_id, text`` and possibly ``row``."""
    row = ["row"] if "row" in docs.columns else []

    def run(batch):
        keys, sizes, bands = [], [], []
        for text in texts(batch.column("text")):
            sequence = words(text)
            shingles = shingle_set(sequence, shingle)
            keys.append(hashlib.md5(sequence).digest())
            sizes.append(len(shingles))
            bands.append(band_keys(shingles) if len(shingles) else [])
        carried = {c: batch.column(c) for c in ["doc_id", *row]}
        return {**carried, "key": keys, "n_shingles": sizes, "bands": bands}

    schema = "doc_id bigint, key binary, n_shingles bigint, bands array<bigint>"
    schema += "".join(f", {c} bigint" for c in row)
    return arrow_map(docs, run, schema, rows=2048)


def _sequences(docs: DataFrame) -> DataFrame:
    """``key`` and compressed words, once per class."""

    def run(batch):
        each = {hashlib.md5(s).digest(): s for s in map(words, texts(batch.column("text")))}
        return {"key": list(each), "packed": [zlib.compress(s, 1) for s in each.values()]}

    found = arrow_map(docs.select("text"), run, "key binary, packed binary")
    return found.groupBy("key").agg(F.first("packed").alias("packed"))


def _confirmed(pairs: DataFrame, sequences: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``pairs`` (key, pivot) with whether they link, and the member's set for later."""
    pivots = sequences.select(F.col("key").alias("pivot"), F.col("packed").alias("pivot_packed"))
    both = pairs.join(sequences.hint("merge"), "key").join(pivots.hint("merge"), "pivot")

    def run(batch):
        last, pivot, linked, sets = None, None, [], []
        columns = [batch.column(c).to_pylist() for c in ("pivot", "pivot_packed", "packed")]
        for name, packed_pivot, packed in zip(*columns):
            if name != last:
                last, pivot = name, shingle_set(zlib.decompress(packed_pivot), shingle)
            own = shingle_set(zlib.decompress(packed), shingle)
            linked.append(_similar(own, pivot, percent))
            sets.append(own.tobytes())
        return {
            "pivot": batch.column("pivot"),
            "key": batch.column("key"),
            "linked": linked,
            "shingles": sets,
        }

    schema = "pivot binary, key binary, linked boolean, shingles binary"
    return arrow_map(both, run, schema, rows=2048)


def _block_links(percent: int):
    """Links between the components of two blocks of sets, from exact intersection sizes."""

    # Workers of the other steps do without pandas, and its memory.
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if right.empty:
            right = left
        found = []
        if len(left):
            pair = [[np.frombuffer(s, np.uint64) for s in x.shingles] for x in (left, right)]
            flat = np.concatenate(pair[0] + pair[1])
            _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count > 1)
            column = np.full(len(count), -1)
            column[shared] = np.arange(len(shared))
            code = column[code]
            sizes = [np.array([len(s) for s in p]) for p in pair]
            row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
            split = sizes[0].sum()
            both = np.zeros((len(left), len(right)), np.float32)
            for at in range(0, len(shared), 1024):
                dense = []
                for r, c, n in (
                    (row[:split], code[:split], len(left)),
                    (row[split:], code[split:], len(right)),
                ):
                    here = (c >= at) & (c < at + 1024)
                    m = np.zeros((n, 1024), np.float32)
                    m[r[here], c[here] - at] = 1
                    dense.append(m)
                both += dense[0] @ dense[1].T
            both = np.rint(both).astype(np.int64)
            union = sizes[0][:, None] + sizes[1][None, :] - both
            a, b = np.nonzero(100 * both >= percent * union)
            names = left.label.to_numpy()[a], right.label.to_numpy()[b]
            found = list({(x, y) for x, y in zip(*names) if x != y})
        return pd.DataFrame(found, columns=["left", "right"])

    return run


def _rest(checked: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a pivot: each such group compared exactly.

    Members are dealt to blocks by size class and hash; sets whose sizes differ by more
    than one class (a factor of ``percent``) cannot link, so only equal and neighbouring
    classes meet."""
    size = F.length("shingles") / 8
    step = F.floor(F.log(size) / float(np.log(100 / percent))).alias("class")
    member = (
        checked.select("pivot", "key", step, F.length("shingles").alias("bytes"))
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .select("pivot", "key", "class", "bytes", F.coalesce("label", F.col("key")).alias("label"))
    )
    several = (
        member.groupBy("pivot")
        .agg(F.min("label").alias("a"), F.max("label").alias("b"))
        .where("a != b")
        .select("pivot")
    )
    # A pivot may have any number of members: fresh shuffles, which can be split.
    member = join_afresh(member, several, ["pivot"], "left_semi", step=1)
    most = F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    blocks = member.groupBy("pivot", "class").agg(F.ceil(most).cast("int").alias("blocks"))
    above = blocks.select("pivot", (F.col("class") - 1).alias("class"), F.col("blocks").alias("up"))
    below = blocks.select("pivot", (F.col("class") + 1).alias("class"), F.col("blocks").alias("down"))
    sizes = blocks.join(above, ["pivot", "class"], "left").join(below, ["pivot", "class"], "left")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def meetings(count, lower_first):
        return F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(0)) - 1), lower_first)

    def meet(lower, i, upper, j, side):
        return F.struct(
            lower.alias("lower"), i.alias("i"), upper.alias("upper"), j.alias("j"),
            F.lit(side).alias("side"),
        )

    own, c = F.col("block"), F.col("class")
    same = meetings(
        F.col("blocks"),
        lambda j: meet(c, F.least(own, j), c, F.greatest(own, j), 0).withField(
            "side", F.when(own <= j, 0).otherwise(1)
        ),
    )
    up = F.when(F.col("up") > 0, meetings(F.col("up"), lambda j: meet(c, own, c + 1, j, 0)))
    down = F.when(F.col("down") > 0, meetings(F.col("down"), lambda j: meet(c - 1, j, c, own, 1)))
    none = F.array().cast(
        "array<struct<lower:bigint,i:int,upper:bigint,j:int,side:int>>"
    )
    dealt = (
        join_afresh(member, sizes, ["pivot", "class"], "inner", step=2)
        .withColumn("block", block)
        .withColumn("at", F.concat(same, F.coalesce(up, none), F.coalesce(down, none)))
        .select("pivot", "key", "label", "at")
        # The sets join last, so that only those still needed are shuffled.
        .join(checked.select("pivot", "key", "shingles").hint("merge"), ["pivot", "key"])
        .select("pivot", "label", "shingles", F.explode("at").alias("at"))
        .select("pivot", "label", "shingles", "at.*")
    )
    return dealt.groupBy("pivot", "lower", "i", "upper", "j").applyInPandas(
        _block_links(percent), "left binary, right binary"
    )


def _labels(docs: DataFrame, features: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``key, label`` of the classes that were candidates; a component's share the label.

    Runs jobs for the components."""
    classes = features.where("n_shingles > 0").groupBy("key")
    bands = classes.agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    pivots = (
        bands.groupBy("band")
        .agg(F.min("key").alias("pivot"), F.count("*").alias("members"))
        .where("members > 1")
        .drop("members")
    )
    met = join_afresh(bands, pivots, ["band"], "inner", step=3)
    pairs = met.where("key != pivot").select("key", "pivot").distinct()
    pairs = stored(pairs, "candidates")
    needed = pairs.select("key").union(pairs.select("pivot")).distinct()
    # These and the sets grow with the corpus, so none is ever broadcast (hence the hints).
    sequences = stored(_sequences(docs).join(needed.hint("merge"), "key", "left_semi"), "sequences")
    checked = stored(_confirmed(pairs, sequences, shingle, percent), "checked")
    labels = stored(components(checked.where("linked"), "key", "pivot"), "labels")
    over = components(_rest(checked, labels, percent), "left", "right")
    over = over.select(F.col("node").alias("label"), F.col("label").alias("top"))
    named = checked.select("key").union(checked.select("pivot")).distinct()
    named = named.join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", F.coalesce("label", F.col("key")).alias("label"))
    return named.join(over, "label", "left").select("key", F.coalesce("top", "label").alias("label"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` and the class ``key`` for every row.

    Rows link when ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id reachable, itself included.  ``kept`` marks rows with that id.
    Runs jobs for the components; the result is lazy.
    """
    docs = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    features = stored(_features(docs, shingle), "minhash")
    labelled = _labels(docs, features, shingle, percent)
    smallest = features.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    grouped = smallest.join(labelled, "key", "left").select(
        "key", F.coalesce("label", F.col("key")).alias("label"), "least"
    )
    ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = grouped.join(ids, "label").select("key", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    # Fresh shuffles, which adaptive execution can split: a text may have any number of copies.
    return (
        join_afresh(features.select("doc_id", "key", "n_shingles"), ids, ["key"], "left", step=1)
        .select("doc_id", "n_shingles", component.alias("component_id"), "key")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row of ``docs`` per component, columns unchanged: the one with the smallest id, of
    several (or of rows that all lack an id) one of them.  Rows without words all stay."""
    whole = whole_row(docs).alias("whole")
    # Numbered once, as written: later reads all see the same numbers.
    rows = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")
    plain = rows.select(F.col("whole")[id_col].alias("doc_id"), F.col("whole")[text_col].alias("text"), "row")
    features = stored(_features(plain, shingle), "minhash")
    labelled = _labels(plain, features, shingle, percent)
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("least")
    firsts = features.where("n_shingles > 0").groupBy("key").agg(least).join(labelled, "key", "left")
    firsts = firsts.groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("least").alias("least"))
    kept = firsts.select("least.row").union(features.where("n_shingles = 0").select("row"))
    return rows.join(kept, "row", "left_semi").select("whole.*")

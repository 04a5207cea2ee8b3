"""Phrase collocations: Misra-Gries summaries per hash partition, then exact counts.

A phrase is two to ``LONGEST`` consecutive words of a piece of text, counted per language.
Three passes over the texts, each a map over batches of bytes:

1. Words and word pairs are hashed, combined within a task and dealt to hash partitions.
   Each partition merges what it gets into one Misra-Gries summary (Agarwal et al., 2012)
   whose capacity exceeds its mass divided by the threshold, so that everything with
   ``threshold`` occurrences survives, whatever else the partition holds.  The masses of a
   partition are sorted ahead of its entries; a partition is streamed, and only its counters
   are held.
2. The same for three to ``LONGEST`` words, left out where a pair in them did not survive
   (a phrase is never more frequent than its parts).
3. Survivors are counted exactly, by their words and not by their hashes.  A task's counts are
   dealt to the hash partitions in rows of many, in order of their hashes, and added up there.

Between the passes the survivors travel as a bitmap of fixed size (``filter_bits``, 16 MB by
default, the only thing broadcast).  A set bit admits others as well, which the exact counts
remove; a fuller bitmap costs time, never results.

Frequent phrases are combined in the map tasks.  A null language is ``und``, a null text is
empty; rows with repeated or null ids all count, as ids play no part.  An empty table gives no rows.  Ties follow
the score, the count and the phrase's UTF-8 bytes, so reruns agree.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from oreline.llm.common import LOWER, Polynomial, arrow_stream, mix, texts
from oreline.sources.paths import stored

LONGEST = 5
UNKNOWN = "und"
# Bytes of text worked on at once (some 50 bytes of arrays for each), and hashes combined before
# they are sent on.
GROUP = 1 << 19
FLUSH = 1 << 21
# Phrases that a task counts before it sends them on, some 200 bytes each.
HELD = 1 << 18
# Hashes in one row between the tasks: with Spark's 10,000 rows a batch about 60 MB.
ROW = 512
# Counted phrases in one row and their bytes (but at least one): with 10,000 rows a batch some 50 MB.
PHRASES, PHRASE_BYTES = 128, 1 << 12
# Hash partitions lie between these; each takes about PART_BYTES of text.
PARTS, PART_BYTES = (64, 1 << 14), 1 << 27

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_POLY, _CHECK = Polynomial(1301), Polynomial(1302)
# 0 a word's byte, 1 a blank, 2 the end of a piece.
_CLASS = np.array(
    [1 if b in b" \t" else 2 if b in b".,;:!?\n\x0b\x0c\r" else 0 for b in range(256)], np.uint8
)
_ANY_END = re.compile(rb"[ \t.,;:!?\n-\r]")
_NEXT_WORDS = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (LONGEST - 1))


def chunks(text: bytes, limit: int = GROUP):
    """``(part, own)``: phrases that start in the first ``own`` bytes of a part belong to it.

    A longer text is cut between words, and each part goes on for the words that the
    phrases started in it may need."""
    at = 0
    while len(text) - at > limit:
        end = _ANY_END.search(text, at + limit)
        if end is None:
            break
        yield text[at : _NEXT_WORDS.match(text, end.start()).end()], end.start() - at
        at = end.start()
    yield text[at:], len(text) - at


@lru_cache(4096)
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of several texts, laid end to end."""

    def __init__(self, parts: list[tuple[str, bytes, int]]):
        self.langs = [lang for lang, _, _ in parts]
        self.bytes = b"\n".join(text for _, text, _ in parts).translate(LOWER)
        data = np.frombuffer(self.bytes, np.uint8)
        kind = _CLASS[data]
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        lengths = np.array([len(text) + 1 for _, text, _ in parts], np.int64)
        first = np.cumsum(lengths) - lengths
        self.part = np.searchsorted(first, self.start, side="right") - 1
        own = first + np.array([n for _, _, n in parts], np.int64)
        self.own = self.start < own[self.part]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.hash = _POLY.hashes(_POLY.prefix(data), self.start, self.end)
        seeds = np.array([_seed(lang) for lang in self.langs], np.uint64)
        self.seed = seeds[self.part]

    def check(self) -> np.ndarray:
        """A second, independent hash of each word."""
        data = np.frombuffer(self.bytes, np.uint8)
        return _CHECK.hashes(_CHECK.prefix(data), self.start, self.end)

    def phrases(self, longest: int, known: np.ndarray | None = None):
        """Per length the hashes and first words of its phrases.  With ``known``, a bitmap,
        those of three words and more hold only pairs that are in it."""
        count = len(self.start)
        key, whole = mix(self.hash ^ self.seed), np.ones(count, bool)
        yield 1, key[self.own], np.flatnonzero(self.own)
        pairs = None
        for n in range(2, min(longest, count) + 1):
            key = mix(key[: count - n + 1] * _GOLDEN + self.hash[n - 1 :])
            whole = whole[: count - n + 1] & (self.piece[: count - n + 1] == self.piece[n - 1 :])
            if n == 2 and known is not None:
                pairs = whole & has(known, key)
            elif n > 2 and known is not None:
                whole = whole & pairs[: count - n + 1] & pairs[n - 2 :]
            at = np.flatnonzero(whole & self.own[: count - n + 1])
            yield n, key[at], at

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.bytes[self.start[at] : self.end[at + n - 1]].split())


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _groups(batches):
    """``Words`` of at most about ``GROUP`` bytes from batches of ``lang, text``."""
    held, size = [], 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, text in zip(langs, texts(batch.column("text"))):
            for part, own in chunks(text):
                held.append((lang, part, own))
                size += len(part)
                if size >= GROUP:
                    yield Words(held)
                    held, size = [], 0
    if held:
        yield Words(held)


def planes(values: np.ndarray) -> bytes:
    """Integers with equal bytes side by side, for the shuffle's compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


class MisraGries:
    """A mergeable summary with at most ``capacity`` counters.

    ``error`` is what a key may have lost, below mass / capacity over all merges."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = add_up(
            np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        )
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.counts -= cut
            stay = self.counts > 0
            self.keys, self.counts = self.keys[stay], self.counts[stay]
            self.error += cut

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key with ``threshold`` occurrences, and perhaps others."""
        return self.keys[self.counts + self.error >= threshold]


def _counted(docs: DataFrame, parts: int, known, longest: int) -> DataFrame:
    """``part, mass`` and ``part, keys, counts`` of what a task combined."""

    def flush(keys):
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(of, prepend=of[:1] - np.uint64(1), append=of[-1:] + np.uint64(1)))
        out = {"part": [], "mass": [], "keys": [], "counts": []}
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = [(int(of[a]), int(counts[a:b].sum()), None, None)]
            for at in range(a, b, ROW):
                step = np.diff(keys[at : min(at + ROW, b)], prepend=np.uint64(0))
                rows.append((int(of[a]), None, planes(step), planes(counts[at : min(at + ROW, b)])))
            for row in rows:
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    def run(batches):
        bits = known.value if known is not None else None
        held, size = [], 0
        for group in _groups(batches):
            for n, keys, _ in group.phrases(longest, bits):
                if (n > 2) == (bits is not None) and len(keys):
                    held.append(keys)
                    size += len(keys)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return arrow_stream(docs, run, "part bigint, mass bigint, keys binary, counts binary")


def _survivors(counted: DataFrame, threshold: int) -> DataFrame:
    """``key`` of all that may have ``threshold`` occurrences, one summary per hash partition."""

    def run(batches):
        part = summary = None
        mass, keys, counts, size = 0, [], [], 0

        def merged():
            if keys:
                summary.merge(np.concatenate(keys), np.concatenate(counts))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "mass")]
            for own, more, key, count in zip(*columns, batch.column("keys"), batch.column("counts")):
                if own != part:
                    if summary is not None:
                        merged()
                        yield {"key": summary.survivors(threshold).view(np.int64)}
                    part, summary, mass, keys, counts, size = own, None, 0, [], [], 0
                if more is not None:
                    mass += more
                    continue
                if summary is None:
                    # More counters than mass / threshold: the error stays below the threshold.
                    summary = MisraGries(mass // threshold + 1)
                keys.append(np.cumsum(from_planes(key.as_buffer(), np.uint64), dtype=np.uint64))
                counts.append(from_planes(count.as_buffer(), np.int64))
                size += len(keys[-1])
                if size >= max(summary.capacity, 1 << 20):
                    merged()
                    keys, counts, size = [], [], 0
        if summary is not None:
            merged()
            yield {"key": summary.survivors(threshold).view(np.int64)}

    # Masses first: a null sorts ahead of the entries.
    dealt = counted.repartition("part").sortWithinPartitions("part", F.isnotnull("keys"))
    return arrow_stream(dealt, run, "key bigint")


def _bitmap(survivors: DataFrame, bits: int) -> np.ndarray:
    """Bit ``key mod bits`` of every survivor, at most ``bits`` / 8 bytes on the driver."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at")
    blocks = (
        survivors.select(at)
        .groupBy(F.floor(F.col("at") / 32768).cast("bigint").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bitmap"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def _exact(docs: DataFrame, known, parts: int, longest: int, threshold: int) -> DataFrame:
    """``lang, words, phrase, f`` of the phrases (and words) in the bitmap with ``threshold``
    occurrences, by their bytes; each language's words as phrase of no words.

    A task's counts are dealt by hash partition in rows of many, sorted by hash, so that a
    partition adds them up in one pass and holds only hashes that later rows may still bring."""

    def add(found, group, check, n, keys, at):
        unique, first, of, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        same = np.ones(len(keys), bool)
        for j in range(n):
            same &= check[at + j] == check[at[first][of] + j]
        if not same.all():  # two phrases of one hash: take each occurrence by itself
            first, counts = np.arange(len(keys)), np.ones(len(keys), np.int64)
        for i, key, c in zip(at[first].tolist(), keys[first].tolist(), counts.tolist()):
            own, phrase = found.setdefault(group.langs[group.part[i]], {}), group.phrase(i, n)
            own[phrase] = (key, own[phrase][1] + c if phrase in own else c)

    def rows(found):
        out = {"part": [], "lang": [], "first": [], "keys": [], "counts": [], "phrases": []}
        for lang, own in found.items():
            phrases = list(own)
            keys = np.array([key for key, _ in own.values()], np.uint64)
            counts = np.array([c for _, c in own.values()], np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            phrases = [phrases[i] for i in order.tolist()]
            of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            # A row ends with its partition, after so many phrases or so many bytes.
            ends = np.cumsum([len(p) + 1 for p in phrases])
            a = 0
            for b in [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)]:
                while a < b:
                    full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PHRASE_BYTES, side="right"))
                    end = min(b, a + PHRASES, max(full, a + 1))
                    row = (
                        int(of[a]), lang, int(keys[a] >> np.uint64(1)),
                        planes(np.diff(keys[a:end], prepend=np.uint64(0))), planes(counts[a:end]),
                        b"\n".join(phrases[a:end]),
                    )
                    for name, value in zip(out, row):
                        out[name].append(value)
                    a = end
        return out

    def run(batches):
        bits, found = known.value, {}
        for group in _groups(batches):
            check = group.check()
            for n, keys, at in group.phrases(longest, bits):
                if n == 1:
                    lang, count = np.unique(group.part[at], return_counts=True)
                    for i, c in zip(lang.tolist(), count.tolist()):
                        own = found.setdefault(group.langs[i], {})
                        own[b""] = (0, own[b""][1] + c if b"" in own else c)
                kept = has(bits, keys)
                if kept.any():
                    add(found, group, check, n, keys[kept], at[kept])
            if sum(map(len, found.values())) >= HELD:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    def frequent(lang, held):
        kept = [(p, c) for p, (_, c) in held.items() if not p or c >= threshold]
        return {
            "lang": [lang] * len(kept),
            "words": [p.count(b" ") + 1 if p else 0 for p, _ in kept],
            "phrase": pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()),
            "f": [c for _, c in kept],
        }

    def merge(batches):
        own, held, limit = None, {}, HELD
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "lang", "first")]
            packs = [batch.column(c) for c in ("keys", "counts", "phrases")]
            for part, lang, first, key, count, phrases in zip(*columns, *packs):
                if own != (part, lang):
                    if held:
                        yield frequent(own[1], held)
                    own, held, limit = (part, lang), {}, HELD
                elif len(held) >= limit:
                    # Rows come by their first hash: smaller ones are complete.
                    yield frequent(lang, {p: v for p, v in held.items() if v[0] >> 1 < first})
                    held = {p: v for p, v in held.items() if v[0] >> 1 >= first}
                    limit = max(HELD, 2 * len(held))
                keys = np.cumsum(from_planes(key.as_buffer(), np.uint64), dtype=np.uint64).tolist()
                counts = from_planes(count.as_buffer(), np.int64).tolist()
                for p, k, c in zip(phrases.as_py().split(b"\n"), keys, counts):
                    held[p] = (k, held[p][1] + c if p in held else c)
        if held:
            yield frequent(own[1], held)

    packed = "part bigint, lang string, first bigint, keys binary, counts binary, phrases binary"
    dealt = arrow_stream(docs, run, packed).repartition("part").sortWithinPartitions("part", "lang", "first")
    return arrow_stream(dealt, merge, "lang string, words int, phrase string, f bigint")


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    threshold: int = 100,
    longest: int = LONGEST,
    filter_bits: int = 1 << 27,
) -> DataFrame:
    """``lang, words, phrase, f`` of all words and phrases with ``threshold`` occurrences, and
    per language a row of no words with the number of all words.  Runs jobs."""
    if not 2 <= longest <= LONGEST or threshold < 1 or filter_bits < 32768 or filter_bits & (filter_bits - 1):
        raise ValueError("phrases need 2 to 5 words, a positive threshold and a power of two of bits")
    docs = docs.select(
        F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = min(max(size // PART_BYTES, PARTS[0]), PARTS[1])
    bits = _bitmap(_survivors(_counted(docs, parts, None, 2), threshold), filter_bits)
    if longest > 2:
        longer = _survivors(_counted(docs, parts, context.broadcast(bits), longest), threshold)
        bits = bits | _bitmap(longer, filter_bits)
    return stored(_exact(docs, context.broadcast(bits), parts, longest, threshold), "phrases")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, n, score`` of phrases of two words and more: the cut with
    the lowest floor(1000 * a * n / (l * r)), the first of several.  Integers throughout."""
    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    candidates = frequent.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    cut = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(word, F.col("k") + 1, F.col("words")), " "))
    )
    part = frequent.where("words > 0")
    left = part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # Each join reads a table and a shuffle of its own keys, so hot first words can be split.
    met = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    # 1000 * a * n < 10**38 up to 10**17 words; div is exact and rounds down.
    met = met.withColumns({f"wide_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(wide_a AS DECIMAL(16,0)) * CAST(wide_n AS DECIMAL(16,0))"
                        " div (CAST(wide_l AS DECIMAL(18,0)) * CAST(wide_r AS DECIMAL(18,0)))")
    )
    lowest = F.min(F.struct("score", "k", "l", "r", "n")).alias("low")
    return met.groupBy("lang", "words", "phrase", "a").agg(lowest).select(
        "lang", "words", "phrase", "a", "low.l", "low.r", "low.n", "low.score"
    )


def _inside(frequent: DataFrame, percent: int) -> DataFrame:
    """Phrases that lie in a longer one with at least ``percent`` of their occurrences."""
    longer = frequent.where("words >= 3").select("lang", "words", "phrase", "f")
    word = F.split("phrase", " ")
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1),
                lambda at: F.array_join(F.slice(F.split("phrase", " "), at, n), " "),
            ),
        )
    )
    parts = longer.select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "f")
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    candidates = frequent.where("words >= 2").select("lang", "phrase", "f")
    return candidates.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= percent * F.col("f")).select(
        "lang", "phrase"
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    threshold: int = 100,
    longest: int = LONGEST,
    percent: int = 100,
    top: int = 2000,
    filter_bits: int = 1 << 27,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase inside a longer candidate that has ``percent`` of its occurrences is left out.
    Runs jobs for the counts; the ranking is lazy."""
    frequent = frequent_phrases(docs, text_col, lang_col, threshold, longest, filter_bits)
    free = scored(frequent).join(_inside(frequent, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within 64 shares of a language, so that no task ranks a whole one.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = free.withColumn("share", share).withColumn(
        "near", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    )
    final = near.where(F.col("near") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    )
    return final.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

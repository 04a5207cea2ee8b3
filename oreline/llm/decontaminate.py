"""Benchmark contamination by one Aho-Corasick automaton.

Items and documents are reduced to their words (ASCII lower-cased; letters, digits and all
non-ASCII characters), joined by single spaces.  Every run of ``window`` consecutive words of
an item is a pattern, a shorter item as a whole is one; the automaton of all patterns scans
each document once.  Matches are mapped to word numbers and to code points of the original.

The automaton is broadcast, so the items are taken in blocks of at most ``BLOCK_BYTES`` of
text on average (one block for usual benchmarks); with several, the documents pass through
one scan after another, in one job.  Documents are never shuffled.

A null or empty text has no words.  Items without words, or without an id, match but are not
named; items that repeat an id count as one.  Null or repeated document ids each give a row.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from oreline.llm.common import WORDS, arrow_map, named, texts, whole_row

BLOCK_BYTES = 1 << 18
_RUNS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))

_BUILT: dict[str, ahocorasick.Automaton] = {}


def word_sequence(text: bytes) -> bytes:
    return b" ".join(text.translate(WORDS).split())


def patterns(items: list[tuple[int | None, bytes]], window: int) -> dict[str, tuple[int, list[int]]]:
    """Per pattern (a space on either side, bytes as Latin-1) its words and its items."""
    found: dict[str, tuple[int, list[int]]] = {}
    for item, text in items:
        words = word_sequence(text).split()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            key = (b" " + b" ".join(words[i : i + size]) + b" ").decode("latin-1")
            named = found.setdefault(key, (size, []))[1]
            if item is not None and item not in named:
                named.append(item)
    return found


def _automaton(name: str, shared) -> ahocorasick.Automaton:
    """Built once per worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for key, value in shared.value.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        _BUILT[name] = automaton
    return _BUILT[name]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that runs of words cover."""
    data = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(point[edge[2 * a]]), int(point[edge[2 * b - 1]])) for a, b in runs]


def _scan(docs: DataFrame, shared, place: int) -> DataFrame:
    """``place``: which field of the row is the text, the only copy of it that is sent."""
    name = uuid.uuid4().hex

    def run(batch):
        automaton = _automaton(name, shared)
        out: dict[str, list] = {"n_words": [], "runs": [], "items": [], "spans": []}
        earlier = zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist())
        for text, (known, items) in zip(texts(batch.column("row").field(place)), earlier):
            sequence = b" " + word_sequence(text) + b" "
            count = sequence.count(b" ") - 1 if len(sequence) > 2 else 0
            runs, items, gaps = [], set(items), None
            if count and len(automaton):
                for at, (size, hit) in automaton.iter(sequence.decode("latin-1")):
                    if gaps is None:
                        gaps = np.flatnonzero(np.frombuffer(sequence, np.uint8) == 32)
                    end = int(np.searchsorted(gaps, at))
                    runs.append((end - size, end))
                    items.update(hit)
            runs = merged(runs + [(r["start"], r["end"]) for r in known])
            spans = original_spans(text, runs) if runs else []
            out["n_words"].append(count)
            out["runs"].append([{"start": a, "end": b} for a, b in runs])
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["items"].append(sorted(items))
        return {"row": batch.column("row"), **out}

    schema = StructType([docs.schema["row"]]).add("n_words", LongType()).add("runs", _RUNS)
    schema = schema.add("items", ArrayType(LongType())).add("spans", _RUNS)
    return arrow_map(docs, run, schema, rows=2048)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """``row`` (the whole input row), ``n_words``, hit ``runs`` of words, their ``spans`` in the
    original, and ``items`` with occurring windows.  Reads ``benchmark`` at once."""
    spark = docs.sparkSession
    items = benchmark.select(
        named(item_col).cast("bigint").alias("item"),
        F.coalesce(named(item_text_col), F.lit("")).cast("binary").alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    found = docs.select(
        whole_row(docs).alias("row"),
        F.array().cast(_RUNS).alias("runs"),
        F.array().cast("array<bigint>").alias("items"),
    )
    place = docs.columns.index(text_col)
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        listed = [(r["item"], bytes(r["text"])) for r in here.collect()]
        found = _scan(found, spark.sparkContext.broadcast(patterns(listed, window)), place)
    return found


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("row")[id_col].alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )

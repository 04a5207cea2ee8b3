"""Removal of byte strings that occur earlier in the corpus.

Every byte covered by a ``length``-byte string (a window) that also starts earlier, in a
document with a smaller id or further left in the same one, is removed.  What is to be found
is which suffixes share their first ``length`` bytes with an earlier one.  This is another
method than external induced sorting: there is no suffix order, no priority queue and no
common-prefix value.  Anchors sampled by content and hash equality find the repeats, sorted
by Spark:

1. *Sample.*  In each window the ``CORE``-byte string with the least hash, leftmost of equals,
   is the anchor.  Equal windows have equal anchors, so the choice needs no coordination and
   every window has exactly one; consecutive windows with one anchor form a span.
2. *Sort.*  One tuple per span (anchor, span, document, start; strings as hashes of 64 and 96
   bits) goes through Spark's disk-backed sort.  Streaming over the sorted tuples, all
   occurrences of a span but the first are repeats as a whole.
3. *Compare.*  Only first occurrences of spans whose anchor has several different spans are
   still open.  They are sampled again, by anchors of three quarters of a window, and their bytes
   are dealt by those; there the windows are told apart, again as sorted tuples.  All other
   windows are unique because their anchor's span is.
4. *Remove.*  Repeats of a document are merged into runs and cut out.

The sorts stream with a state of one row, so no group of equal strings is ever gathered.
Repeats inside one batch are resolved before they are shuffled, and a document's spans
spread over all partitions, so copies do not make a hot partition.  A passage shorter than
``length`` that many documents have in different contexts does: its spans share an anchor
and are sorted, on disk, by one task.

A null text is empty; texts shorter than ``length`` lose nothing.  Rows with repeated ids are
ordered by a hash of the text, and of rows equal in both one counts as the earlier, so of
repeated rows one stays whole; rows without an id come after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import Polynomial, arrow_map, texts
from oreline.sources.paths import stored

CORE = 32
_CHUNK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
_ONE, _TWO = Polynomial(202), Polynomial(303)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _least(prefix: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-byte strings, and of each window which of them is its anchor."""
    core = _ONE.fixed(prefix, size)
    place = np.arange(len(core), dtype=np.uint64)
    least = _sliding_min((core & ~_POSITION) | place, length - size + 1) & _POSITION
    return core, least.astype(np.int64)


def spans(data: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """``anchor`` and span hashes ``one, two``, ``start`` and ``size`` (bytes) of all spans.

    Spans do not cross chunks of a million windows, which bounds the memory."""
    out: dict[str, list] = {k: [] for k in ("anchor", "one", "two", "start", "size")}
    for at in range(0, len(data) - length + 1, _CHUNK):
        here = data[at : at + _CHUNK + length - 1]
        prefix = _ONE.prefix(here)
        core, least = _least(prefix, length, CORE)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.concatenate([start[1:], [len(least)]]) - 1 + length
        out["anchor"].append(core[least[start]].view(np.int64))
        out["one"].append(_ONE.hashes(prefix, start, end).view(np.int64))
        out["two"].append((_TWO.hashes(_TWO.prefix(here), start, end) >> np.uint64(32)).astype(np.int64))
        out["start"].append(start + at)
        out["size"].append(end - start)
    none = np.zeros(0, np.int64)
    return {k: np.concatenate(v) if v else none for k, v in out.items()}


def _starts(starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of some strings."""
    count = sizes - length + 1
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count - starts, count)


def pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """``anchor, start, size`` of strings that have the windows of some spans, each once: those
    next to each other with one anchor of three quarters of their length."""
    size = max(min(CORE, length), length - length // 4)
    window = np.sort(_starts(starts, sizes, length))
    for at in range(0, len(data) - length + 1, _CHUNK):
        here = window[slice(*np.searchsorted(window, [at, at + _CHUNK]))] - at
        if not len(here):
            continue
        core, least = _least(_ONE.prefix(data[at : at + _CHUNK + length - 1]), length, size)
        least = least[here]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(here) != 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(here)]]) - 1
        yield core[least[first]].view(np.int64), here[first] + at, here[last] - here[first] + length


def windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Hashes ``one, two`` and ``start`` of the windows of some spans."""
    start = _starts(starts, sizes, length)
    one = _ONE.hashes(_ONE.prefix(data), start, start + length).view(np.int64)
    two = (_TWO.hashes(_TWO.prefix(data), start, start + length) >> np.uint64(32)).astype(np.int64)
    return {"one": one, "two": two, "start": start}


def _firsts(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows are the first of their string by document and start."""
    order = np.lexsort((rows["start"], rows["doc"], rows["two"], rows["one"]))
    one, two = rows["one"][order], rows["two"][order]
    first = np.ones(len(order), bool)
    first[order[1:]] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return first


def _runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Overlapping or touching pieces of a document merged (input in any order)."""
    if not len(doc):  # a batch without repeats
        return {"doc": doc, "start": start, "size": size}
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    # The furthest end so far, document by document.
    shift = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) if len(doc) else doc
    width = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + shift * width) - shift * width
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return {"doc": doc[at], "start": start[at], "size": reach[last] - start[at]}


# Kinds of rows: a string to sort, a repeat to remove, a span still open.
_SORT, _REPEAT, _OPEN = 0, 1, 2
_KEYED = "anchor bigint, one bigint, two int, doc bigint, start bigint, size int, kind tinyint"
_FOUND = "doc bigint, start bigint, size bigint, kind tinyint"


def _tuples(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The first row of each string in the batch, to sort; of the others, merged, the repeats.
    (``size`` is the string's, ``anchor`` what rows are dealt by.)"""
    first = _firsts(rows)
    out = {k: v[first] for k, v in rows.items()}
    repeat = _runs(*(rows[k][~first] for k in ("doc", "start", "size")))
    n, m = len(out["doc"]), len(repeat["doc"])
    joined = {k: np.concatenate([out[k], repeat[k]]) for k in ("doc", "start", "size")}
    # Repeats only pass through; their document spreads them.
    joined["anchor"] = np.concatenate([out["anchor"], repeat["doc"]])
    for k in ("one", "two"):
        joined[k] = np.concatenate([out[k], np.zeros(m, np.int64)])
    joined["two"] = joined["two"] - (1 << 31)
    joined["kind"] = np.repeat([_SORT, _REPEAT], [n, m])
    return joined


def _empty() -> dict[str, list]:
    return {k: [np.zeros(0, np.int64)] for k in ("anchor", "one", "two", "doc", "start", "size")}


def _spans_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batch):
        rows = _empty()
        for doc, text in zip(batch.column("doc").to_numpy(), texts(batch.column("text"))):
            found = spans(np.frombuffer(text, np.uint8), length)
            for k, v in found.items():
                rows[k].append(v)
            rows["doc"].append(np.full(len(found["start"]), doc))
        return _tuples({k: np.concatenate(v) for k, v in rows.items()})

    return arrow_map(docs.select("doc", "text"), run, _KEYED)


def _pieces_of(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, doc, start, piece``: the bytes of the open spans, cut into spans by anchors that
    fill most of a window.  ``docs``: doc, packed, open (starts and sizes of open spans).

    A piece is little longer than a window but has a dozen of them, so that the bytes take less
    room in the shuffle than the windows' hashes."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("anchor", "doc", "start", "piece")}
        unpack = zstandard.ZstdDecompressor()
        columns = [batch.column(c) for c in ("doc", "packed", "starts", "sizes")]
        for doc, packed, starts, sizes in zip(*columns):
            text = unpack.decompress(packed.as_py())
            starts, sizes = (x.values.to_numpy().astype(np.int64) for x in (starts, sizes))
            for anchor, start, size in pieces(np.frombuffer(text, np.uint8), starts, sizes, length):
                start = start.tolist()
                out["anchor"] += anchor.tolist()
                out["doc"] += [doc.as_py()] * len(start)
                out["start"] += start
                out["piece"] += [text[i : i + n] for i, n in zip(start, size.tolist())]
        return out

    return arrow_map(docs, run, "anchor bigint, doc bigint, start bigint, piece binary", rows=256)


def _windows_of(pieces: DataFrame, length: int) -> DataFrame:
    """The windows of the pieces, where their anchors were dealt."""

    def run(batch):
        pieces = batch.column("piece")
        ends = np.cumsum([len(p.as_buffer()) for p in pieces])
        sizes = np.diff(ends, prepend=0)
        data = np.frombuffer(b"".join(p.as_buffer() for p in pieces), np.uint8)
        found = windows(data, ends - sizes, sizes, length)
        of = np.searchsorted(ends, found["start"], side="right")
        rows = {"one": found["one"], "two": found["two"]}
        rows["doc"] = batch.column("doc").to_numpy()[of]
        rows["start"] = batch.column("start").to_numpy()[of] + found["start"] - (ends - sizes)[of]
        return _tuples(rows | {"anchor": rows["one"], "size": np.full(len(of), length)})

    return arrow_map(pieces, run, _KEYED, rows=1 << 13)


_ORDER = ["anchor", "kind", "one", "two", "doc", "start"]


def _sorted_repeats(dealt: DataFrame) -> DataFrame:
    """Stream over tuples dealt by anchor and sorted: repeats, and open first occurrences.

    A first occurrence is open if its anchor has another string.  Whether it has is known
    with the next string, so one row waits from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy() for n in ("anchor", "one", "two", "doc", "start", "size", "kind")}
            col = {n: v.astype(np.int64) for n, v in col.items()}
            before = {
                n: np.concatenate([[col[n][0] if last is None else last[n]], col[n][:-1]])
                for n in ("anchor", "one", "two", "kind")
            }
            other = (col["anchor"] != before["anchor"]) | (col["kind"] != before["kind"])
            if last is None:
                other[0] = True
            fresh = other | (col["one"] != before["one"]) | (col["two"] != before["two"])
            sort = col["kind"] == _SORT
            repeat = (sort & ~fresh) | (col["kind"] == _REPEAT)
            first = np.flatnonzero(sort & fresh)
            follows = ~other[first]  # not the first string of its anchor
            is_open = follows.copy()
            is_open[:-1] |= follows[1:]
            found = []
            if len(first):
                if waiting is not None and follows[0]:
                    found.append(waiting)
                tail = first[-1]
                waiting = None
                if not is_open[-1]:
                    waiting = tuple(int(col[n][tail]) for n in ("doc", "start", "size"))
            kind = np.where(repeat, _REPEAT, _OPEN)
            chosen = repeat.copy()
            chosen[first[is_open]] = True
            extra = np.array(found, np.int64).reshape(-1, 3)
            columns = [
                np.concatenate([col[n][chosen], extra[:, i]]) for i, n in enumerate(("doc", "start", "size"))
            ]
            kinds = np.concatenate([kind[chosen], np.full(len(extra), _OPEN)]).astype(np.int8)
            last = {n: col[n][-1] for n in ("anchor", "one", "two", "kind")}
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(kinds)], ["doc", "start", "size", "kind"]
            )

    return dealt.mapInArrow(run, _FOUND)


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with their text compressed, for the shuffles by document."""

    def run(batch):
        pack = zstandard.ZstdCompressor(level=3)
        return {
            "doc": batch.column("doc"),
            "doc_id": batch.column("doc_id"),
            "packed": [pack.compress(t) for t in texts(batch.column("text"))],
        }

    return arrow_map(docs, run, "doc bigint, doc_id bigint, packed binary")


def _cut(docs: DataFrame) -> DataFrame:
    def run(batch):
        unpack = zstandard.ZstdDecompressor()
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for packed, starts, sizes in zip(*(batch.column(c) for c in ("packed", "starts", "sizes"))):
            text = unpack.decompress(packed.as_py())
            edge = np.zeros(len(text) + 1, np.int64)
            if starts.is_valid:
                start, size = (x.values.to_numpy().astype(np.int64) for x in (starts, sizes))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1)))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        return {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return arrow_map(docs, run, schema)


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc`` is a number in the order of the ids: the id itself where ids are unique, else
    the place after a sort by id (nulls last) and hash of the text."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("doc", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``kept`` bytes per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _numbered(rows)
    dealt = _spans_of(rows, length).repartition("anchor").sortWithinPartitions(*_ORDER)
    found = stored(_sorted_repeats(dealt), "spans")
    packed = _packed(rows)
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("start", "size")]
    opened = found.where(F.col("kind") == _OPEN).groupBy("doc").agg(*lists)
    pieces = _pieces_of(packed.drop("doc_id").join(opened, "doc"), length).repartition("anchor")
    again = _windows_of(pieces, length).sortWithinPartitions(*_ORDER)
    again = stored(_sorted_repeats(again).where(F.col("kind") == _REPEAT), "windows")
    removed = found.where(F.col("kind") == _REPEAT).unionByName(again).groupBy("doc").agg(*lists)
    return _cut(packed.join(removed, "doc", "left"))

"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.llm import exact_dedup, minhash, suffix_dedup
from oreline.llm.components import components

from .conftest import LOWER, edited, prose


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def first(ids):
    return min((i for i in ids if i is not None), default=None)


# -- exact ---------------------------------------------------------------------


def exact_model(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return Counter(
        (i, first(ids), len(ids), i == first(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    )


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_edge_cases(documents, edge_rows):
    found = exact_dedup.exact_duplicates(documents(edge_rows))
    assert found.columns == list(EXACT)
    assert rows_of(found, *EXACT) == exact_model(edge_rows)


@pytest.mark.parametrize("weak", ["length(text) % 2", "1"])
def test_collisions_of_the_hash_change_nothing(documents, edge_rows, weak):
    found = exact_dedup.exact_duplicates(documents(edge_rows), hash_fn=lambda t: F.expr(f"{weak}"))
    assert rows_of(found, *EXACT) == exact_model(edge_rows)


def test_exact_empty(documents):
    assert exact_dedup.exact_duplicates(documents([])).isEmpty()


# -- near ----------------------------------------------------------------------


def near_model(rows, size, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            label[find(b)] = find(a)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        component = first(members[find(i)]) if sets[i] else doc
        out[doc, len(sets[i]), component, doc == component] += 1
    return out


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def family(n=60):
    """Copies of one text whose links among each other are few, and a chain."""
    base = prose(7, 240)
    rows = [(100 + i, edited(base, 9 + i % 12, i)) for i in range(n)]
    step = prose(8, 200)
    for i in range(12):
        step = edited(step, 60, i)
        rows.append((300 - i, step))
    return rows


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80), (2, 90)])
def test_near_duplicates(documents, edge_rows, size, percent):
    rows = edge_rows + family()
    found = minhash.near_duplicates(documents(rows), shingle=size, percent=percent)
    assert rows_of(found, *NEAR) == near_model(rows, size, percent)


def test_groups_larger_than_a_block(documents, monkeypatch):
    """The exact comparison, dealt to many blocks, finds links that no pivot has."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = family(80)
    found = minhash.near_duplicates(documents(rows), shingle=3, percent=85)
    assert rows_of(found, *NEAR) == near_model(rows, 3, 85)


def test_near_empty_and_removal(documents, edge_rows):
    assert minhash.near_duplicates(documents([])).isEmpty()
    docs = documents(family())
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c[2] for c in near_model(family(), 5, 80)}


def test_removal_goes_by_rows_not_ids(documents, edge_rows):
    """Repeated and null ids bring no copy back: one row per component, and all without words."""
    base = prose(1, 200)
    rows = [*edge_rows, (None, base), (12, base), (21, prose(5, 90)), (21, prose(5, 90)), (None, prose(6, 90)), (None, prose(6, 90))]
    # Model ids tell the rows apart: by id, null last, then by place.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    model = near_model([(n, rows[i][1]) for n, i in enumerate(order)], 5, 80)
    expected = Counter(rows[order[n]] for n, _, _, kept in model if kept)
    docs = documents(rows)
    found = minhash.without_near_duplicates(docs)
    assert found.columns == docs.columns
    assert rows_of(found, "doc_id", "text") == expected
    assert minhash.without_near_duplicates(documents([])).isEmpty()


def test_signatures_estimate_the_similarity():
    a = np.unique(minhash.mix(np.arange(1, 3001, dtype=np.uint64)))
    estimates = []
    for share in range(1, 10):
        b = np.unique(minhash.mix(np.arange(300 * share, 3000 + 300 * share, dtype=np.uint64)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        estimates.append(np.mean(minhash.signature(a) == minhash.signature(b)) - true)
    assert max(map(abs, estimates)) < 0.15 and abs(np.mean(estimates)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 205), (205, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    expected = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 205: 200}
    assert {r.node: r.label for r in found.collect()} == expected and found.count() == len(expected)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


# -- substrings ----------------------------------------------------------------


def repeats_model(rows, length=100):
    """By id, then text for repeated ids (equal rows: one of them first), nulls last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((rows[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def passages(n=25):
    shared = [prose(50 + i, 30 + 8 * i) for i in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(1000 + i, 20 + i), shared[i % 4], prose(2000 + i, 15), shared[(i // 2) % 4]]
        rows.append((i * 3, "\n".join(parts) + " äöü" * (i % 5)))
    base = prose(77, 120)
    rows += [(200 + i, edited(base, 30 + i, i)) for i in range(10)]
    return rows + [(400, "ab" * 400), (401, "ab" * 300), (402, base), (403, base), (404, None), (405, "x" * 99)]


def test_repeats(documents):
    found = suffix_dedup.remove_repeats(documents(passages()))
    assert rows_of(found, *REPEATS) == repeats_model(passages())
    kept = {r.doc_id: bytes(r.kept) for r in found.collect()}
    assert kept[403] == b"" and kept[405] == b"x" * 99


def test_repeats_with_repeated_ids(documents, edge_rows):
    """Ids without repeated rows of unlike text: the order among those is by a hash."""
    rows = [r for r in edge_rows if r != (12, prose(3, 40))] + passages()
    found = suffix_dedup.remove_repeats(documents(rows))
    got, model = rows_of(found, *REPEATS), repeats_model(rows)
    null = lambda c: Counter({k: n for k, n in c.items() if k[0] is None})
    assert got - null(got) == model - null(model)
    assert {k[1] for k in null(got)} == {k[1] for k in null(model)}
    assert sum(got.values()) == len(rows)


def test_spans_do_not_depend_on_chunks(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    found = suffix_dedup.remove_repeats(documents(passages()))
    assert rows_of(found, *REPEATS) == repeats_model(passages())


def test_repeats_empty_and_other_length(documents):
    assert suffix_dedup.remove_repeats(documents([])).isEmpty()
    found = suffix_dedup.remove_repeats(documents(passages()), length=40)
    assert rows_of(found, *REPEATS) == repeats_model(passages(), 40)


def test_open_spans_travel_as_pieces_smaller_than_their_windows():
    """The windows' hashes took several times the room of the bytes they stand for."""
    data = np.frombuffer(prose(5, 900).encode(), np.uint8)
    rows = suffix_dedup.spans(data, 100)
    opened = slice(3, None, 2)
    starts, sizes = rows["start"][opened], rows["size"][opened]
    wanted = [w for a, n in zip(starts, sizes) for w in range(a, a + n - 99)]
    parts = list(suffix_dedup.pieces(data, starts, sizes, 100))
    anchor, start, size = (np.concatenate(c) for c in zip(*parts))
    assert sorted(w for a, n in zip(start, size) for w in range(a, a + n - 99)) == sorted(wanted)
    # A window alone tells its anchor, so equal windows meet.
    for a, n, key in zip(start.tolist(), size.tolist(), anchor.tolist()):
        for w in range(a, a + n - 99):
            ((only, _, _),) = suffix_dedup.pieces(data[w : w + 100], np.array([0]), np.array([100]), 100)
            assert only.tolist() == [key]
    assert size.sum() + 24 * len(size) < 20 * len(wanted)


def test_pieces_without_repeats(spark):
    data = np.random.default_rng(3).integers(32, 127, 120).astype(np.uint8).tobytes()
    pieces = spark.createDataFrame([(1, 7, 40, data)], "anchor bigint, doc bigint, start bigint, piece binary")
    found = suffix_dedup._windows_of(pieces, 100).orderBy("start").collect()
    assert [(r["doc"], r["start"], r["kind"]) for r in found] == [(7, 40 + i, suffix_dedup._SORT) for i in range(21)]

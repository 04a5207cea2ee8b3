"""Quality scores, ranked search and phrases against brute-force versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from oreline.llm import phrases, ranked_search, text_quality
from oreline.sources.paths import stored
from .conftest import LOWER, edited, prose

# -- phrases -----------------------------------------------------------------


def brute_phrases(rows, threshold, percent=100, top=2000):
    """``rows``: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for k in range(1, 6):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            cuts = [
                (1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, l, r = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found_phrases(df):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def phrase_rows():
    draw = random.Random(5)
    rows = [(5, None, "en", None), (6, "", "en", None), (7, " \t\n.", None, None), (None, "one", None, None)]
    words = [f"w{i}" for i in range(12)] + ["É", "日本", "The", "the", "a b", "🙂"]
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(40))
        rows.append((i % 50, text, draw.choice(["en", "en", "de", "", None, "und"]), None))
    # Copies, a third of all rows, and one very long text without an end of a piece.
    rows += [(900, "same words over and over again here", "en", None)] * 60
    rows.append((901, prose(4, 30_000, 40), "fr", None))
    return rows


def test_phrases_equal_brute_force(documents):
    rows = phrase_rows()
    for threshold, percent, top in ((3, 100, 2000), (8, 50, 7)):
        df = phrases.collocations(documents(rows), threshold=threshold, percent=percent, top=top, filter_bits=1 << 15)
        assert found_phrases(df) == brute_phrases([(r[2], r[1]) for r in rows], threshold, percent, top)


def test_phrases_of_nothing(documents):
    assert found_phrases(phrases.collocations(documents([]))) == []
    assert found_phrases(phrases.collocations(documents([(1, None, None, None), (2, " ", "en", None)]), threshold=1)) == []


@pytest.mark.parametrize("bad", [{"threshold": 0}, {"longest": 6}, {"longest": 1}, {"filter_bits": 100_000}])
def test_phrases_refuse_wrong_settings(documents, bad):
    with pytest.raises(ValueError):
        phrases.collocations(documents([(1, "a b", "en", None)]), **bad)


@given(st.lists(st.integers(0, 12), max_size=300), st.integers(1, 40), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_every_frequent_key_survives_its_summary(keys, threshold, size):
    summary = phrases.MisraGries(len(keys) // threshold + 1)
    for at in range(0, len(keys), size):
        unique, counts = np.unique(np.array(keys[at : at + size], np.uint64), return_counts=True)
        summary.merge(unique, counts)
        assert len(summary.keys) <= summary.capacity
    assert summary.error < threshold
    frequent = {k for k, c in Counter(keys).items() if c >= threshold}
    assert frequent <= set(summary.survivors(threshold).tolist())


@given(st.text("ab .\t", max_size=200), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_cut_texts_hold_the_same_phrases(text, limit):
    def counted(parts):
        group, out = phrases.Words([("en", part, own) for part, own in parts]), Counter()
        for n, _, at in group.phrases(5):
            out.update(group.phrase(i, n) for i in at.tolist())
        return out

    whole = text.encode()
    assert counted(phrases.chunks(whole, limit)) == counted([(whole, len(whole))])


def test_colliding_hashes_are_told_apart_by_words(documents, monkeypatch):
    """With one hash for all, every phrase is counted by its bytes."""
    group = phrases.Words([("en", b"a b a b a c", 11)])
    known = np.full(4096, 255, np.uint8)
    assert phrases.has(known, group.hash).all()
    seen = Counter()
    for n, keys, at in group.phrases(2, known):
        assert len(keys) == len(at)
        seen.update(group.phrase(i, n) for i in at.tolist())
    assert seen == {b"a": 3, b"b": 2, b"c": 1, b"a b": 2, b"b a": 2, b"a c": 1}


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert (phrases.from_planes(phrases.planes(values), np.uint64) == values).all()


# -- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_search(docs, items, top):
    counts = [(i, Counter(terms(text))) for i, text in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, words = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(terms(text)), []
        for i, c, n in counts:
            m = 75 + 25 * n * n_docs // words
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in query.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort(key=lambda s: s[:3])
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def search_items():
    base = prose(1, 200)
    return [(1, None), (2, ""), (3, "."), (4, base[:80]), (4, base[:80]), (None, "w1 w2 w2 w2 É"), (6, "nowhere at all"),
            (7, "THE the w7"), (8, prose(8, 60)), (9, "日本語 🙂")]


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_search_equals_brute_force(spark, documents, edge_rows, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    rows = edge_rows + [(100 + i, prose(i, 30 + i, 50)) for i in range(80)] + [(300, prose(70, 100, 50))] * 40
    docs = documents(rows).repartition(5)
    items = spark.createDataFrame([(*r, "x") for r in search_items()], "item_id bigint, text string, `a b` string")
    for top in (3, 20):
        found = ranked_search.search(stored(ranked_search.build_index(docs), "index"), items, top=top)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(rows, search_items(), top)


def test_search_without_documents_or_items(spark, documents):
    items = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    for docs in (documents([]), documents([(1, None), (2, " ")])):
        assert ranked_search.search(stored(ranked_search.build_index(docs), "index"), items).collect() == []
    some = stored(ranked_search.build_index(documents([(1, "w1")])), "index")
    assert ranked_search.search(some, items.limit(0)).collect() == []


def shard(texts, vocabulary):
    counts = [Counter(t.encode() for t in terms(text)) for text in texts]
    batch = pa.RecordBatch.from_pydict(
        {
            "terms": [[t.decode() for t in c] for c in counts],
            "tfs": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            "n": pa.array([sum(c.values()) for c in counts], pa.int64()),
        }
    )
    return ranked_search.Shard(batch, pa.array(vocabulary), len(texts), sum(sum(c.values()) for c in counts))


def test_shards_hold_every_document_once(monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_TERMS", 5)
    lists = [["a"] * n for n in (0, 3, 2, 1, 9, 0, 0, 4, 4, 12)]
    batch = pa.RecordBatch.from_pydict({"terms": pa.array(lists, pa.list_(pa.string())), "n": list(range(10))})
    parts = list(ranked_search.shards([batch, batch.slice(0, 0), batch.slice(3, 4)]))
    assert [r for p in parts for r in p.column("n").to_pylist()] == [*range(10), *range(3, 7)]
    assert all(p.num_rows == 1 or len(p.column("terms").flatten()) <= 5 for p in parts)


def test_best_positions_stop_before_the_lists_end():
    """One document leads all lists by far: the bound falls below it after the first reads."""
    texts = ["a b c " * 50] + [f"a b c {'x ' * 200} y{i}" for i in range(3000)]
    index = shard(texts, ["a", "b", "c"])
    found, scores, read = index.search([(0, 10), (1, 10), (2, 10)], 1, np.zeros(0, np.int64))
    assert found.tolist() == [0] and read < 500
    # Ties with the k-th are never left out, so equal documents are all met.
    found, scores, read = shard(["a"] * 500, ["a"]).search([(0, 10)], 3, np.zeros(0, np.int64))
    assert len(found) == 500 and read == 500


def test_scores_known_from_other_shards_end_a_search():
    index = shard([f"a {'x ' * 20}"] * 4000, ["a"])
    best = np.array([10**12] * 3)
    found, _, read = index.search([(0, 1)], 3, best)
    assert len(found) == 0 and read <= 32


def test_length_norm_past_64_bits():
    n, documents, words = 10**9, 10**10, 10**15
    assert ranked_search.length_norm(np.array([n]), documents, words).tolist() == [75 + 25 * n * documents // words]


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE", 7)
    text = "Alpha beta-beta, gamma É alpha " * 50
    assert ranked_search.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


# -- quality -----------------------------------------------------------------


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(text_quality, "FEATURES", 20_000)
    x = np.random.default_rng(1).normal(size=(30, 20))
    z = text_quality.Fourier(np.zeros(20), np.ones(20), 1.0)(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 20))).max() < 0.04


def test_sums_of_tasks_give_the_ridge_solution(spark):
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(900, 20)).astype(np.float32), draw.integers(0, 2, 900)
    rows = [(a.tolist(), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    learnt = spark.createDataFrame(rows, "x array<float>, y double, fold int").repartition(7)
    kernels = [text_quality.Fourier(np.zeros(20), np.ones(20), w) for w in (1.0, 2.0)]
    sums = text_quality.normal_equations(learnt, kernels)
    assert sorted(sums) == [(i, f) for i in range(2) for f in range(3)]
    z = kernels[1](x.astype(float))
    rest = np.arange(900) % 3 != 2
    w = text_quality.ridge(sums[1, 0] + sums[1, 1], 1e-3)
    penalty = np.diag([600 * 1e-3] * text_quality.FEATURES + [0])
    assert np.allclose(w, np.linalg.solve(z[rest].T @ z[rest] + penalty, z[rest].T @ y[rest]), atol=1e-6)
    assert np.isclose(text_quality.squared_error(sums[1, 2], w), ((z[~rest] @ w - y[~rest]) ** 2).sum())


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_the_least_squares_fit(rows):
    total = np.array([min(a, b) for a, b in rows], float)
    count = np.array([b for _, b in rows], float)
    at, share = text_quality.isotonic(np.arange(len(rows), dtype=float), total, count)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
    # max over starts of min over ends of the means between, a closed form of the fit
    i = range(len(rows))
    best = [max(min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in i if b >= j) for a in i if a <= j) for j in i]
    assert np.allclose(sorted(set(np.round(best, 9))), share)


def test_statistics_of_cut_texts(monkeypatch):
    texts = ["", "a", prose(1, 500), "É日本 🙂 " * 40, "x|y | z!! " * 100, "W" * 300]
    whole = [text_quality.statistics(t.encode()) for t in texts]
    monkeypatch.setattr(text_quality, "_CHUNK", 16)
    for text, expected in zip(texts, whole):
        assert len(expected) == len(text_quality.NAMES) and np.isfinite(expected).all()
        assert np.allclose(text_quality.statistics(text.encode()), expected)


def quality_rows():
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = ". ".join(prose(i * 7 + j, 12).capitalize() for j in range(8))
        rows.append((i, text if good else " | ".join(text.upper().split())))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_rows_are_told_apart(spark, documents, edge_rows):
    rows, labels = quality_rows()
    extra = [(i + 10_000 if i is not None else None, t) for i, t in edge_rows]
    judged = text_quality.judge_quality(documents(rows + extra), spark.createDataFrame(labels, LABELS))
    found = judged.collect()
    assert judged.columns == ["doc_id", "held_out", "score", "predicted"]
    assert len(found) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out is not None and (r.doc_id is not None or not r.held_out)
    again = text_quality.judge_quality(documents(rows + extra), spark.createDataFrame(labels, LABELS))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_scores_never_see_held_out_labels(spark, documents):
    """Labels of held-out rows, labels of no document and null labels change nothing."""
    rows, labels = quality_rows()
    docs = documents(rows)
    held = {r.doc_id for r in docs.select("doc_id", text_quality.held_out("doc_id").alias("h")).collect() if r.h}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels] + [(10**6, 0, 0), (None, 0, 0), (1, None, 0)]
    scores = [
        sorted(map(tuple, text_quality.judge_quality(docs, spark.createDataFrame(x, LABELS)).collect()))
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_few_or_no_labels(spark, documents, edge_rows):
    docs = documents(edge_rows)
    none = text_quality.judge_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(edge_rows) and {r.score for r in none} == {0.5}
    # Conflicting labels of one document, and one kind of label only.
    for labels in ([(8, 0, 0), (8, 1, 0)], [(8, 1, 0), (9, 1, 0), (10, 1, 0)]):
        some = text_quality.judge_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(some) == len(edge_rows) and all(0 <= r.score <= 1 for r in some)
    assert text_quality.judge_quality(documents([]), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_edited_texts_keep_their_statistics():
    base = prose(1, 400)
    a, b = (text_quality.statistics(t.encode()) for t in (base, edited(base, 50)))
    assert np.abs(a - b).max() < 0.2


def test_counted_phrases_travel_in_rows_of_many_not_one_by_one(spark):
    """One row per phrase and task made rows by the square of the input."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)] * 8
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    bits = spark.sparkContext.broadcast(np.full(1 << 12, 255, np.uint8))
    exact = phrases._exact(docs, bits, 2, 3, 8)
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "phrases" in plan and "Aggregate" not in plan
    found = {(r["words"], r["phrase"]): r["f"] for r in exact.collect()}
    expected = {(n, " ".join(t.split()[j : j + n])): 8 for t in texts for n in (1, 2, 3) for j in range(41 - n)}
    assert found == expected | {(0, ""): 30 * 40 * 8}
    rare = phrases._exact(docs, bits, 2, 3, 9).collect()
    assert [(r["words"], r["f"]) for r in rare] == [(0, 30 * 40 * 8)]

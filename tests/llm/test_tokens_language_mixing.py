"""Token files, language identification, decontamination, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from oreline.llm import decontaminate, language_id, mixing, token_output
from oreline.sources.paths import scratch_path

from .conftest import CLASHING, LOWER, prose

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


# -- tokens --------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
@settings(max_examples=200, deadline=None)
def test_packed_numbers_round_trip(numbers):
    ranks = np.array(numbers, np.uint32)
    control, data = token_output.pack(ranks)
    assert len(control) == -(-len(numbers) // 4)
    assert token_output.unpack(control, data, len(numbers)).tolist() == numbers


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_output.default_tokenizer())


TRICKY = [
    "<|endoftext|> it's I'LL Ça vá é", "a b c　d\x0be\x1cf", "́ lead́", "ΣΑΣ İstanbul ﬁ",
    " 12345 !?.. ###\t\n\r\n", "日本語 テスト 🙂🙂", "퟿ \x00\x01",
]


def test_token_files(spark, documents, edge_rows, tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 500)
    rows = [*edge_rows, *((1000 - i, t) for i, t in enumerate(TRICKY))]
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(documents(rows), path)
    found = token_output.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in found]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in found)
    assert got == Counter((i, tuple(ids[t])) for i, t in rows)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    uses = Counter(x for _, t in rows for x in ids[t])
    assert [r.id for r in ranks] == sorted(uses, key=lambda i: (-uses[i], i))
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 10
    again = scratch_path(spark, "tokens")
    token_output.write_tokens(documents(rows), again, by_word=False)
    assert Counter(token_output.read_tokens(spark, again).collect()) == Counter(
        token_output.read_tokens(spark, path).collect()
    )


@given(st.lists(st.text(st.sampled_from("abzAZéÉßΣİक़'’.,!*<|>01 \n\t\u0301") | st.characters(), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_words_apart_encode_as_the_whole(tokenizer, texts):
    encoder = token_output.Encoder.of(token_output.default_tokenizer(), True)
    for text in [*texts, *TRICKY, "<|endoftext|>. <|ENDOFTEXT|>! x<|endoftext|>y.", "don't! DON'T' b's's... ''s"]:
        text = text.encode("utf-8", "ignore").decode()
        assert encoder.ids(text, 1).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_token_files_of_nothing(spark, documents):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(documents([]), path)
    assert token_output.read_tokens(spark, path).isEmpty()


# -- language ------------------------------------------------------------------

SOUNDS = {"xx": "ba be bo zu", "yy": "kra kre kri kro", "zz": "lla lle ña ño"}


def spoken(lang, seed, n=60):
    draw = np.random.default_rng(seed)
    parts = SOUNDS[lang].split()
    return " ".join("".join(draw.choice(parts, 3)) for _ in range(n))


def labelled(n=60):
    return [(i, spoken(lang, 100 + i), lang, "s") for i in range(n) for lang in [list(SOUNDS)[i % 3]]]


def predicted(docs, model):
    found = language_id.predict(docs, model)
    return {r.row.doc_id: (r.lang_pred, r.score) for r in found.collect()}


def test_held_out_accuracy_and_unknown(documents):
    odd = [(900, None), (901, ""), (902, "123 !! 🙂"), (903, "é"), (None, spoken("xx", 5), "yy", "s"), (904, spoken("yy", 1, 50_000))]
    docs = documents(labelled() + odd + [labelled()[0]])
    model = language_id.fit(docs)
    assert model.languages == ["xx", "yy", "zz"]
    found = predicted(docs, model)
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 5 and all(found[i][0] == list(SOUNDS)[i % 3] for i in range(60))
    assert all(found[i] == ("und", 0.0) for i in (900, 901, 902)) and found[904][0] == "yy"
    assert all(0 <= s <= 1 for _, s in found.values())
    flags = docs.select("doc_id", language_id.held_out("doc_id").alias("h")).where("h").collect()
    assert {r.doc_id for r in flags} == {i for i in [*range(60), *range(900, 905)] if zlib.crc32(str(i).encode()) % 4 == 2}


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(documents):
    rows = labelled()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang, _ in rows]
    one, two = (predicted(documents(r), language_id.fit(documents(r))) for r in (rows, wrong))
    assert one == two


def test_sample_bound(documents):
    docs = documents(labelled(240))
    small = language_id.fit(docs, rows_per_language=12)
    hits = [predicted(docs, small)[i][0] == list(SOUNDS)[i % 3] for i in range(240)]
    assert np.mean(hits) > 0.9


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "abc"), (2, None)])
    assert language_id.fit(docs) is None
    assert predicted(docs, None) == {1: ("und", 0.0), 2: ("und", 0.0)}
    assert predicted(documents([]), language_id.fit(documents([]))) == {}


def test_penalties_make_the_weights_sparse():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(300):
        noise = draw.integers(10, 5000, 20)
        rows.append((np.unique(np.append(noise, i % 2)), None, i % 2))
    rows = [(b, np.full(len(b), 1 / len(b)), k) for b, _, k in rows]
    loose, _ = language_id.train_ftrl(rows, 2, l1=0.0)
    tight, _ = language_id.train_ftrl(rows, 2, l1=0.3)
    assert np.count_nonzero(tight) < 0.2 * np.count_nonzero(loose)
    assert tight[0, 0] > 0 > tight[0, 1] and tight[1, 1] > 0 > tight[1, 0]


def test_temperature():
    logits, truth = np.array([[4.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)
    t = language_id.fit_temperature(logits, truth)
    assert abs(language_id.softmax(logits[0] / t)[0] - 0.7) < 0.02


def test_no_temperature_without_errors():
    with pytest.warns(UserWarning, match="uncalibrated"):
        assert language_id.fit_temperature(np.array([[4.0, 0.0], [0.0, 4.0]] * 5), np.array([0, 1] * 5)) == 1.0


def bucket(gram):
    """The published hash of one n-gram, in whole numbers."""
    factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    total = (ord(gram[0]) + 1) * factors[0]
    for i, c in enumerate(gram[1:], 1):
        total += ord(c) * factors[i] + i
    total %= 2**64
    return ((total ^ (total >> 29)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - language_id.BITS)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_scores_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "_CHUNK", chunk)
    draw = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], draw.normal(size=(language_id.BUCKETS, 3)), draw.normal(size=3), 0.7)
    for text in ("x", "Ab", "é ß 日本語 🙂", "İstanbul ΣΑΣ", spoken("zz", 3)):
        low = text.lower()
        grams = [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]
        logits = np.mean([model.weights[bucket(g)].astype(float) for g in grams], axis=0) + model.bias
        p = np.exp(logits / 0.7) / np.exp(logits / 0.7).sum()
        lang, score = model.predict(text)
        assert lang == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-9


# -- decontamination -----------------------------------------------------------


def hits_model(rows, items, window=10):
    wins = {}
    for item, text in items:
        words = re.findall(WORD, (text or "").translate(LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            wins.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = Counter()
    for doc, text in rows:
        words, hit, named = re.findall(WORD, (text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(words) - n + 1):
                found = wins.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    named |= found - {None}
        listed = ",".join(sorted(map(str, named)))
        out[doc, len(words), len(hit), len(named), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)] += 1
    return out


ITEMS = [
    (1, prose(31, 25)), (2, "Short Item é"), (2, "other short"), (10, prose(31, 12)), (3, None), (4, "  ...  "),
    (None, prose(32, 15)), (5, "the"), (6, prose(33, 10)), (6, prose(33, 10)),
]


@pytest.mark.parametrize("block", [1 << 18, 60])
def test_contamination(spark, documents, edge_rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    twelve = prose(31, 25).split()
    rows = edge_rows + [
        (50, "x y " + prose(31, 25) + " z"), (51, " ".join(twelve[3:13])), (52, " ".join(twelve[3:12])),
        (53, "SHORT,item--É! the end"), (54, "ashort item é"), (55, prose(32, 15).upper().replace(" ", " ... ")),
        (56, prose(33, 10) + " " + prose(33, 10)), (57, ("é " * 40 + prose(33, 10)) * 50),
    ]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, row string")
    found = decontaminate.scan(documents(rows), items)
    got = Counter(tuple(r) for r in decontaminate.report(found).collect())
    assert got == hits_model(rows, ITEMS)
    text = dict(rows)
    for r in found.where("size(runs) > 0").collect():
        whole = text[r.row.doc_id]
        words = [m.span() for m in re.finditer(WORD, whole.translate(LOWER))]
        assert [tuple(s) for s in r.spans] == [(words[a][0], words[b - 1][1]) for a, b in r.runs]


def test_contamination_of_and_by_nothing(spark, documents, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.scan(documents(edge_rows), none)).collect())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(decontaminate.scan(documents([]), items)).isEmpty()


# -- mixing --------------------------------------------------------------------


def targets_model(sizes, most=3):
    """Sizes per source in order; share by weight again and again."""
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sizes)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        share = (total - sum(full.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if weight[s] * share > most * sizes[s]]
        if not over:
            return {**full, **{s: weight[s] * share for s in free}}
        full.update({s: most * sizes[s] for s in over})


def mixable(seed, sources):
    draw = np.random.default_rng(seed)
    rows, i = [], 0
    for name, n in sources:
        for _ in range(n):
            rows.append((i, prose(9000 + i, int(draw.integers(1, 400))), "en", name))
            i += 1
    return rows


@pytest.mark.parametrize("sources", [
    [("a", 150), ("b", 40), (None, 60), ("B", 3), ("é", 90)],
    [("tiny", 1), ("huge", 200)],
    [("z", 30)],
])
def test_mixture(documents, sources):
    rows = mixable(len(sources), sources)
    rows += [(None, "no id here", "en", "z"), (9001, None, "en", "empty"), (9002, "", "en", "z"), rows[0], (9003, prose(4, 20_000), "en", "z")]
    docs = documents(rows)
    found = mixing.mixture(docs, block_words=16, shard_slots=64, spread=5)
    got = found.collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(SPACED, text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    model = targets_model({s: sizes[s] for s in names})
    source_of = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(model[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert len(got) == len(rows)
    for s in names:
        assert abs(taken[s] - model[s]) <= 16 + 0.01 * model[s], (s, taken[s], model[s])
    again = mixing.mixture(docs.repartition(3), block_words=16, shard_slots=64, spread=5)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


def test_mixed_documents_hold_the_taken_words(documents):
    rows = mixable(5, [("a", 40), ("b", 40), ("c", 5)]) + [(900, None, "en", "a"), (901, " \n", "en", None)]
    docs = documents(rows)
    settings_ = {"block_words": 16, "shard_slots": 64, "spread": 3}
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs, **settings_).collect()}
    mixed = mixing.mixed_documents(docs, **settings_)
    assert mixed.columns == docs.columns
    got, text = Counter(), {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        words, whole = r.text.split(" "), iter(re.findall(SPACED, text[r.doc_id]))
        assert all(w in whole for w in words)  # in order
        assert r.source == dict((x[0], x[3]) for x in rows)[r.doc_id] and r[CLASHING[0]] == "x"
        got[r.doc_id] += len(words)
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_mixture_of_nothing(documents):
    assert mixing.mixture(documents([])).isEmpty()
    assert mixing.mixed_documents(documents([])).isEmpty()
    assert mixing.mixed_documents(documents([(1, None), (2, "")])).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations(n):
    seen = [mixing.permuted(np.arange(n), n, key) for key in (0, 1, 12345)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in seen)
    assert n < 64 or not np.array_equal(seen[0], seen[1])


def test_draws_past_the_limit_of_numpy(monkeypatch):
    """By inversion: the whole distribution of a small case, mean and spread of a huge one."""
    monkeypatch.setattr(mixing, "NUMPY_LIMIT", 0)
    draw = np.random.default_rng(9)
    have, rest, take = 7, 12, 9
    exact = [math.comb(have, k) * math.comb(rest, take - k) / math.comb(have + rest, take) for k in range(have + 1)]
    got = np.bincount([mixing.hypergeometric(draw, have, rest, take) for _ in range(20_000)], minlength=have + 1) / 20_000
    assert np.abs(got - exact).max() < 0.015
    have, rest, take = 3 * 10**11, 7 * 10**11, 10**8
    got = np.array([mixing.hypergeometric(draw, have, rest, take) for _ in range(400)])
    assert abs(got.mean() - 3e7) < 4 * 4583 / 20 and abs(got.std() / 4583 - 1) < 0.15
    for have, rest, take in ((0, 5, 3), (5, 0, 3), (4, 6, 10), (10**12, 1, 10**12), (1, 10**12, 10**12)):
        n = mixing.hypergeometric(draw, have, rest, take)
        assert max(0, take - rest) <= n <= min(have, take)



def test_shard_draws_add_up_and_vary():
    slots, shards, size = [5000, 300, 0, 1], 54, 100
    found = [mixing.shard_counts(slots, shards, size, i, seed=3) for i in range(shards)]
    assert np.sum([here for here, _ in found], 0).tolist() == slots
    assert all(sum(here) == min(size, sum(slots) - i * size) for i, (here, _) in enumerate(found))
    before = np.zeros(4, int)
    for here, first in found:
        assert first == before.tolist()
        before += here
    assert len({here[1] for here, _ in found}) > 3


# -- pipeline ------------------------------------------------------------------


def test_pipeline_over_small_tables(spark, tmp_path):
    import corpus_pipeline

    item = "what is the capital of the seventh province of nowhere land"
    rows = [(*r[:3], f"s{r[0] % 3}", len(r[1])) for r in labelled(60)]
    rows += [(700, rows[0][1] + " more", "xx", "s0", 0), (701, rows[1][1] + " " + item, "yy", "s1", 0), (702, "0 1 2", None, "s0", 5)]
    rows += [(703, None, None, None, None), (704, "", "xx", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, near, clean, mixed = kept
    assert language == {*range(60), 700, 701}
    assert near == language - {700, 701} or near == language - {700}
    assert clean == near - {701} and mixed <= clean
    counts = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert counts.count() == docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mix", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, counts.collect()))


def test_frequent_words_stay_remembered(monkeypatch):
    """Words that come again and again are worked out once, however many rare ones pass."""
    monkeypatch.setattr(token_output, "_CACHE_BYTES", 64 * 1024)
    encoder = token_output.Encoder(token_output.default_tokenizer(), True)
    worked, plain = [], encoder._words._worked_out
    monkeypatch.setattr(encoder._words, "_worked_out", lambda word: worked.append(word) or plain(word))
    letters = "abcdefghij"
    for i in range(1000):
        rare = "".join(letters[int(d)] for d in f"{i:06d}")
        text = f"the {rare} of"
        whole = encoder._tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text, 1).tolist() == [*whole, 1]
    assert worked.count("the") == worked.count("of") == 1 and len(worked) == 1002
    assert len(encoder._words) + len(encoder._words._before) < 320

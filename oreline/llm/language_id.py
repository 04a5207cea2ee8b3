"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (one to three characters of the lower-cased
text, hashed to ``BUCKETS``): the n-gram's share of the text times log((1 + N) / (1 + n)) + 1,
n of N labelled documents having it.  The weights are trained with follow-the-regularised-
leader (McMahan et al., 2013) under L1 and L2 penalties, one softmax over all languages, and
the scores are calibrated by one temperature fitted on labelled rows kept from the training.

Document frequencies cover all labelled rows.  The weights are fitted on a sample: at most
``rows_per_language`` (1200) rows of each language are expected (all of a rarer one), chosen by
a hash of the id, so the driver holds a number of rows that does not grow with the corpus.
Prediction is one pass without a shuffle and reads nothing but the text, whole.

A text that is null or has no letter is ``und`` with score 0, as is every text if there are
no labelled rows.  Rows without an id are not held out and, as their number says nothing,
not learnt from.  Repeated ids each give a row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from oreline.llm.common import arrow_map, named, whole_row

BITS = 16
BUCKETS = 1 << BITS
UNKNOWN = "und"
_CHUNK = 1 << 18

# Odd multipliers of the n-gram hash, fixed for reruns.
_A, _B, _C = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_D = np.uint64(0xD6E8FEB86659FD93)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The bucket of every n-gram occurrence, a long text's in parts by where they start."""
    text = text.lower()
    for at in range(0, max(len(text), 1), _CHUNK):
        part = text[at : at + _CHUNK + 2].encode("utf-32-le", "surrogatepass")
        x = np.frombuffer(part, np.uint32).astype(np.uint64)
        one = (x + np.uint64(1)) * _A
        two = one[:-1] + x[1:] * _B + np.uint64(1)
        three = two[:-1] + x[2:] * _C + np.uint64(2)
        started = np.concatenate([one[:_CHUNK], two[:_CHUNK], three[:_CHUNK]])
        yield (((started ^ (started >> np.uint64(29))) * _D) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Weights (buckets by languages, IDF folded in), biases and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages = languages
        self.weights = weights.astype(np.float32)
        self.bias, self.temperature = bias, temperature

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for grams in ngrams(text):
            total += self.weights[grams].sum(0, dtype=np.float64)
            n += len(grams)
        return total / max(n, 1) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    languages: int,
    idf: np.ndarray | None = None,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 0.1,
    l1: float = 1e-4,
    l2: float = 1e-5,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-Proximal over ``(buckets, shares, language)`` rows; weights and biases."""
    idf = np.ones(BUCKETS) if idf is None else idf
    z = np.zeros((BUCKETS + 1, languages))
    n = np.zeros((BUCKETS + 1, languages))
    penalty = np.full((BUCKETS + 1, 1), l1)
    penalty[BUCKETS] = 0  # the bias

    def weights(at):
        pull = np.abs(z[at]) - penalty[at]
        return np.where(pull > 0, -np.sign(z[at]) * pull / ((beta + np.sqrt(n[at])) / alpha + l2), 0)

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            buckets, values, language = rows[i]
            at, x = np.append(buckets, BUCKETS), np.append(values * idf[buckets], 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[language] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, on a logarithmic grid from 1/30 to 30, which is
    widened twice where the least lies at its edge.  If it still does, the rows say nothing about
    the temperature (all are told apart, or none): a warning, and no calibration."""
    if not len(truth):
        return 1.0
    for width in (30, 900, 27_000):
        grid = np.exp(np.linspace(-np.log(width), np.log(width), 137))
        loss = [log_loss(logits / t, truth) for t in grid]
        best = int(np.argmin(loss))
        if 0 < best < len(grid) - 1:
            return float(grid[best])
    warnings.warn("no temperature fits best; scores are left uncalibrated", stacklevel=2)
    return 1.0


def log_loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(-1)
    total = top + np.log(np.exp(logits - top[:, None]).sum(-1))
    return float((total - logits[np.arange(len(truth)), truth]).mean())


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def _document_frequencies(labelled: DataFrame) -> np.ndarray:
    def run(batches):
        df, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column(0):
                for grams in ngrams(text.as_py()):
                    seen[grams] = True
                df += seen
                seen[:] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    counted = labelled.select("text").mapInArrow(run, "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 1200,
) -> Model | None:
    """Learn from the labelled rows; None if there are none.  Runs jobs."""
    rows = docs.select(
        named(id_col).alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang")
    )
    labelled = rows.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).where(~held_out("doc_id"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rate = F.element_at(
        F.create_map(
            *[F.lit(v) for k in languages for v in (k, min(1.0, rows_per_language / counts[k]))]
        ),
        F.col("lang"),
    )
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    sample = labelled.where(drawn < rate)

    def features(batch):
        buckets, shares = [], []
        for text in batch.column("text"):
            n = sum(np.bincount(grams, minlength=BUCKETS) for grams in ngrams(text.as_py()))
            at = np.flatnonzero(n)
            buckets.append(at.astype(np.int32))
            shares.append((n[at] / max(n.sum(), 1)).astype(np.float32))
        return {**{c: batch.column(c) for c in ("doc_id", "lang")}, "buckets": buckets, "shares": shares}

    schema = "doc_id bigint, lang string, buckets array<int>, shares array<float>"
    drawn_rows = arrow_map(sample.select("doc_id", "lang", "text"), features, schema).toArrow()
    drawn_rows = drawn_rows.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    df = _document_frequencies(labelled)
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    number = {k: i for i, k in enumerate(languages)}
    # Views of two flat arrays, one row after the other.
    buckets, shares = (drawn_rows.column(c).combine_chunks() for c in ("buckets", "shares"))
    cuts = buckets.offsets.to_numpy()[1:-1] - buckets.offsets[0].as_py()
    data = list(
        zip(
            np.split(buckets.flatten().to_numpy(), cuts),
            np.split(shares.flatten().to_numpy(), cuts),
            [number[k] for k in drawn_rows.column("lang").to_pylist()],
        )
    )
    learnt = [r for i, r in enumerate(data) if i % 5] or data
    kept = [r for i, r in enumerate(data) if i % 5 == 0]
    weights, bias = train_ftrl(learnt, len(languages), idf)
    logits = np.array([(x * idf[b]) @ weights[b] + bias for b, x, _ in kept])
    temperature = fit_temperature(logits, np.array([k for *_, k in kept]))
    return Model(languages, weights * idf[:, None], bias, temperature)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row`` (the whole input row), ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(whole_row(docs).alias("row"), lettered)
    place = docs.columns.index(text_col)

    def run(batch):
        known = shared.value
        texts = batch.column("row").field(place)  # the only copy of the text that is sent
        found = [
            known.predict(text.as_py()) if has and known is not None else (UNKNOWN, 0.0)
            for text, has in zip(texts, batch.column("lettered").to_pylist())
        ]
        return {
            "row": batch.column("row"),
            "lang_pred": [p[0] for p in found],
            "score": [p[1] for p in found],
        }

    schema = StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType())
    return arrow_map(rows, run, schema, rows=2048)

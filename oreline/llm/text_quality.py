"""Text quality: ridge regression on random Fourier features, with isotonic calibration.

Statistics of the whole text (lengths, shares of kinds of bytes, repetition, entropy; ``NAMES``)
are standardised over the labelled rows.  Random Fourier features (Rahimi and Recht, 2007)
approximate a Gaussian kernel over them.  Tasks sum the normal equations of their rows; the sums
are added in two rounds, so no task or driver gets more than a fixed number of matrices.  They
are kept by fold, from which the driver has every cross-validated ridge solution and its exact
squared error without another pass; that chooses kernel width and penalty.  Isotonic regression
(pool adjacent violators) over each row's score by the folds it was not part of turns scores
into shares of good texts.  For it scores are counted in ``BINS`` steps, rows in all of them.

All labelled rows that are not held out are learnt from.  A label above 0 is good.  Of several
labels of one document their mean counts, a null label does not, nor do rows without an id.
Empty and null texts have the statistics of an empty text and are scored like any other.
Without labelled rows every score is 0.5.  Rows with repeated or null ids each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import LOWER, Polynomial, arrow_map, arrow_stream, mix, texts
from oreline.llm.language_id import held_out
from oreline.operators.absent import join_afresh
from oreline.sources.paths import stored

NAMES = [
    "bytes", "words", "word_bytes", "letters", "upper", "digits", "stops", "symbols", "blanks",
    "lines", "sentence_words", "entropy", "distinct", "commonest", "repeated_triples",
    "capitalised", "odd_ends", "no_letters", "long_words", "other_script",
]
FEATURES, FOLDS = 256, 3
WIDTHS = (0.5, 1.0, 2.0)
PENALTIES = tuple(10.0**e for e in range(-7, 1))
BINS, LOW, HIGH = 4096, -1.0, 2.0
_CHUNK = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_POLY = Polynomial(1101)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, list(b".,;:!?'\"()-"))
_END = np.isin(_BYTES, list(b".!?"))
_ODD = ~(_LETTER | _DIGIT | _STOP | _BLANK)
_LOWERED = np.frombuffer(LOWER, np.uint8)


def _chunks(text: bytes):
    """Pieces of about ``_CHUNK`` bytes, cut at a space or a line's end."""
    at = 0
    while len(text) - at > _CHUNK:
        cuts = [c for c in (text.find(s, at + _CHUNK) for s in (b" ", b"\n")) if c >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:]


def statistics(text: bytes) -> np.ndarray:
    """The ``NAMES`` of one text."""
    count, words, capital, odd_end, wordless, long_words = np.zeros(256), [], 0, 0, 0, 0
    for chunk in _chunks(text):
        data = np.frombuffer(chunk, np.uint8)
        count += np.bincount(data, minlength=256)
        edges = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        words.append(_POLY.hashes(_POLY.prefix(_LOWERED[data]), start, end))
        capital += np.count_nonzero(_UPPER[data[start]])
        odd_end += np.count_nonzero(_ODD[data[end - 1]])
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        wordless += np.count_nonzero(letters[end] == letters[start])
        long_words += np.count_nonzero(end - start > 24)
    word = np.concatenate(words)
    n, w = max(len(text), 1), max(len(word), 1)
    _, occurrences = np.unique(word, return_counts=True)
    triples = mix(mix(word[:-2] * _GOLDEN + word[1:-1]) * _GOLDEN + word[2:])
    share = count[count > 0] / n
    letters = count[_LETTER].sum()
    return np.array(
        [
            np.log1p(len(text)),
            np.log1p(len(word)),
            np.log1p((n - count[_BLANK].sum()) / w),
            letters / n,
            count[_UPPER].sum() / max(letters, 1),
            count[_DIGIT].sum() / n,
            count[_STOP].sum() / n,
            count[_ODD].sum() / n,
            count[_BLANK].sum() / n,
            count[10] / w,
            np.log1p(w / (1 + count[_END].sum())),
            -(share * np.log2(share)).sum(),
            len(occurrences) / w,
            occurrences.max(initial=0) / w,
            1 - len(np.unique(triples)) / len(triples) if len(triples) else 0,
            capital / w,
            odd_end / w,
            wordless / w,
            long_words / w,
            count[128:].sum() / n,
        ]
    )


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics ``x`` of every row; lazy."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batch):
        x = [statistics(t).astype(np.float32) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "x": x}

    return arrow_map(named, run, "doc_id bigint, x array<float>", rows=2048)


class Fourier:
    """Standardisation and random features of one kernel width, fixed for reruns."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = draw.normal(size=(len(mean), FEATURES)) / (width * np.sqrt(len(mean)))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        standard = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(standard @ self.turn + self.phase)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)


class Model:
    def __init__(self, features: Fourier | None, weights: np.ndarray | None, at: np.ndarray, share: np.ndarray):
        self.features, self.weights, self.at, self.share = features, weights, at, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.at, self.share), 0, 1)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), len(NAMES))


def _added(blobs: DataFrame) -> DataFrame:
    """Sums of the float64 ``blob`` per ``id``, within a task; one matrix per id is held."""

    def run(batches):
        sums = {}
        for batch in batches:
            for i, blob in zip(batch.column("id").to_pylist(), batch.column("blob")):
                values = np.frombuffer(blob.as_py(), np.float64)
                sums[i] = sums[i] + values if i in sums else values
        yield {"id": list(sums), "blob": [s.tobytes() for s in sums.values()], "share": [0] * len(sums)}

    return arrow_stream(blobs, run, "id int, blob binary, share int")


def normal_equations(learnt: DataFrame, features: list[Fourier]) -> dict[tuple[int, int], np.ndarray]:
    """Per kernel width and fold the sums of (features, label)' (features, label)."""
    side = FEATURES + 2

    def run(batches):
        sums = np.zeros((len(features), FOLDS, side, side))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = _rows(part.column("x")), part.column("y").to_numpy()
                fold = part.column("fold").to_numpy()
                for i, make in enumerate(features):
                    z = np.concatenate([make(x), y[:, None]], axis=1)
                    for f in range(FOLDS):
                        sums[i, f] += z[fold == f].T @ z[fold == f]
        yield {
            "id": list(range(len(features) * FOLDS)),
            "blob": [s.tobytes() for s in sums.reshape(-1, side * side)],
        }

    each = arrow_stream(learnt.select("x", "y", "fold"), run, "id int, blob binary")
    each = each.withColumn("share", F.spark_partition_id() % 64)
    near = _added(each.repartition("id", "share"))
    total = _added(near.repartition("id")).select("id", "blob")
    return {
        divmod(r["id"], FOLDS): np.frombuffer(r["blob"], np.float64).reshape(side, side)
        for r in total.toLocalIterator()
    }


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from the normal equations; the constant is not penalised."""
    n = max(sums[-2, -2], 1)
    left = sums[:-1, :-1] + n * penalty * np.diag([1.0] * FEATURES + [1e-9])
    return np.linalg.solve(left, sums[:-1, -1])


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    """Of ``weights`` over the rows behind ``sums``."""
    return float(weights @ sums[:-1, :-1] @ weights - 2 * weights @ sums[:-1, -1] + sums[-1, -1])


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middles and means of the blocks, both ascending."""
    blocks: list[list[float]] = []
    for x, s, n in zip(at, total, count):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _labelled(described: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``x, y, fold`` of the rows to learn from."""
    good = (F.col(f"`{label_col}`") > 0).cast("double")
    truth = labels.select(F.col(f"`{id_col}`").alias("doc_id"), good.alias("y")).where("doc_id IS NOT NULL")
    truth = truth.where("y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = described.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    return join_afresh(rows, truth, ["doc_id"], "inner", step=11).select("x", "y", fold)


def fit(
    described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> Model:
    """Learn from ``describe``d rows and their labels.  Runs jobs."""
    learnt = stored(_labelled(described, labels, id_col, label_col), "learnt")
    moments = (
        learnt.select(F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))
        .collect()
    )
    if not moments:
        return Model(None, None, np.zeros(0), np.zeros(0))
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["mean"], r["scale"] if r["scale"] > 1e-9 else 1.0
    kernels = [Fourier(mean, scale, width) for width in WIDTHS]
    sums = normal_equations(learnt, kernels)
    whole = {i: sum(sums[i, f] for f in range(FOLDS)) for i in range(len(kernels))}

    def without(i, f, penalty):
        return ridge(whole[i] - sums[i, f], penalty)

    def error(i, penalty):
        return sum(squared_error(sums[i, f], without(i, f, penalty)) for f in range(FOLDS))

    _, i, penalty = min((error(i, p), i, p) for i in range(len(kernels)) for p in PENALTIES)
    at, share = _calibration(learnt, kernels[i], np.stack([without(i, f, penalty) for f in range(FOLDS)]))
    return Model(kernels[i], ridge(whole[i], penalty), at, share)


def _calibration(learnt: DataFrame, features: Fourier, by_fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic blocks over scores by the weights of the other folds."""

    def run(batch):
        raw = (features(_rows(batch.column("x"))) * by_fold[batch.column("fold").to_numpy()]).sum(1)
        step = np.floor((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1)).astype(np.int32)
        return {"bin": step, "raw": np.clip(raw, LOW, HIGH), "y": batch.column("y")}

    scores = arrow_map(learnt, run, "bin int, raw double, y double")
    bins = scores.groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.sum("y").alias("good"), F.count("*").alias("n")
    )
    rows = sorted(bins.collect())
    return isotonic(*(np.array([r[c] for r in rows], float) for c in ("raw", "good", "n")))


def score(described: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; lazy."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "score": shared.value.score(_rows(batch.column("x")))}

    scores = arrow_map(described, run, "doc_id bigint, score double")
    good = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", good)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
) -> DataFrame:
    """Describe, fit and score; the texts are read once.  Runs jobs; the scoring is lazy."""
    described = stored(describe(docs, id_col, text_col), "statistics")
    return score(described, fit(described, labels, id_col, label_col), threshold)

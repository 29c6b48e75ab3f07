"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Text is folded to lower-case words with single spaces; its distinct 4- and 5-grams are
hashed into buckets.  Over a bounded labelled sample, written once, the log-count ratio of
every bucket that occurs is counted, and a logistic regression is fitted on all of these; its
margins are calibrated on parts of the sample that were left out.
Scoring adds up a dense table's weights of each whole text's distinct buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.decontaminate import words_of
from tidemark.llm.labelled import fold, labelled_sample

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
SIZES = (4, 5)
BITS = 20


def ngram_buckets(text: bytes | None) -> np.ndarray:
    """The buckets of all n-grams of the folded text, with repeats."""
    b = np.frombuffer(b" " + b" ".join(words_of(text)) + b" ", np.uint8).astype(np.uint32)
    out = []
    for size in SIZES:
        n = len(b) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, np.uint32)
        for i in range(size):
            h = (h + b[i : i + n]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class NgramModel:
    """Weight of every bucket (zero: not seen in training) and the intercept."""

    table: np.ndarray
    intercept: float

    @classmethod
    def constant(cls, p: float) -> NgramModel:
        return cls(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))

    def scorer(self):
        seen = np.zeros(1 << BITS, np.int32)

        def score(text: bytes | None) -> float:
            found = ngram_buckets(text)
            place = np.arange(len(found), dtype=np.int32)
            seen[found] = place  # of equal buckets the last place stays, so each counts once
            z = self.intercept + float(self.table[found[seen[found] == place]].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(ngram_buckets(text.as_py())).astype(np.int32) for text in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "at"]
        )


def lbfgs(loss, w: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimises a smooth convex function; ``loss(w)`` gives its value and gradient."""
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, weights = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * float(s @ d)
            weights.append(a)
            d -= a * y
        if steps:
            s, y, _ = steps[-1]
            d *= float(s @ y) / float(y @ y)
        for (s, y, r), a in zip(steps, reversed(weights), strict=True):
            d += (a - r * float(y @ d)) * s
        slope = float(g @ d)
        if slope < 1e-12:
            break
        size = 1.0 if steps else min(1.0, 1 / float(np.abs(g).sum()))
        while True:
            new = w - size * d
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = new - w, g_new - g
        if float(s @ y) > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / float(s @ y))]
        w, f, g = new, f_new, g_new
    return w


def fit_logistic(
    flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, ratio: np.ndarray, *, rounds: int = 15, l2: float = 1e-3, chunk: int = 1 << 21
) -> tuple[np.ndarray, float]:
    """Weights over NB-scaled binary features on the full sample, and the intercept.

    ``flat`` holds the features of all rows one after the other, ``sizes`` how many each row has.
    """
    n, ends = len(y), np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(flat) + chunk, chunk), side="left").clip(0, n))
    parts = [(a, b, slice(ends[a] - sizes[a], ends[b - 1])) for a, b in zip(cuts, [*cuts[1:], n], strict=True) if a < b]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, value, g = (w[:-1] * ratio), 0.5 * l2 * float(w[:-1] @ w[:-1]), np.zeros_like(w)
        for a, b, own in parts:
            row = np.repeat(np.arange(b - a), sizes[a:b])
            z = np.bincount(row, scaled[flat[own]], b - a) + w[-1]
            value += float((np.logaddexp(0, z) - y[a:b] * z).sum()) / n
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) / n
            g[:-1] += np.bincount(flat[own], error[row], len(ratio))
            g[-1] += error.sum()
        g[:-1] = g[:-1] * ratio + l2 * w[:-1]
        return value, g

    w = np.zeros(len(ratio) + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    w = lbfgs(loss, w, rounds)
    return w[:-1], float(w[-1])


SMOOTHING = 3.0  # documents added to each count of the log-count ratios
LEFT_OUT = 3  # every third row of the sample is scored by a model of the others to calibrate the scores


def _rows(flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The features of some rows."""
    return flat[np.repeat(keep, sizes)]


def fit_table(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of every bucket, ratio included, and the intercept."""
    pos, both = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for part in np.array_split(np.arange(len(y)), 1 + len(flat) // (1 << 21)):
        own = flat[ends[part[0]] : ends[part[-1] + 1]]
        pos += np.bincount(own, np.repeat(y[part], sizes[part]), 1 << BITS)
        both += np.bincount(own, minlength=1 << BITS)
    n_pos, k = y.sum(), SMOOTHING
    ratio = np.log((pos + k) / (n_pos + 2 * k)) - np.log((both - pos + k) / (len(y) - n_pos + 2 * k))
    ratio[both == 0] = 0
    weights, intercept = fit_logistic(flat, sizes, y, ratio)
    return weights * ratio, intercept


def _margins(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray, intercept: float) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(table[flat])])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return sums[ends[1:]] - sums[ends[:-1]] + intercept


def calibration(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make margins of unseen documents probabilities (1 and 0 where a part lacks a class).

    A part of the sample is scored by a model of the rest; a logistic regression of its labels
    on these margins, with the targets drawn in a little, gives both numbers.
    """
    own = np.arange(len(y)) % LEFT_OUT == 0
    if len(np.unique(y[own])) < 2 or len(np.unique(y[~own])) < 2:
        return 1.0, 0.0
    table, intercept = fit_table(_rows(flat, sizes, ~own), sizes[~own], y[~own])
    z, y = _margins(_rows(flat, sizes, own), sizes[own], table, intercept), y[own]
    n_pos, spread = y.sum(), z.std() + 1e-9
    wanted = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (len(y) - n_pos + 2))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = w[0] * z / spread + w[1]
        error = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - wanted) / len(y)
        return float((np.logaddexp(0, m) - wanted * m).mean()), np.array([(error * z / spread).sum(), error.sum()])

    scale, shift = lbfgs(loss, np.array([1.0, 0.0]), 100)
    return max(float(scale / spread), 0.0), float(shift)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model of all rows: its intercept and its table."""
    labels, lists = [np.zeros(0)], [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    for batch in batches:
        at = batch.column(2)
        labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        lists.append((at.flatten().to_numpy().copy(), np.diff(at.offsets.to_numpy()).astype(np.int64)))
    y, flat, sizes = np.concatenate(labels), np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])
    lists.clear()
    if 0 < y.sum() < len(y):
        table, intercept = fit_table(flat, sizes, y)
        scale, shift = calibration(flat, sizes, y)
        model = NgramModel((scale * table).astype(np.float32), scale * intercept + shift)
    else:
        model = NgramModel.constant((y.sum() + 1) / (len(y) + 2))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.intercept]), pa.array([model.table.tobytes()], pa.binary())], names=["intercept", "weights"]
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
          label_col: str = "toxic", sample_rows: int = 8_000) -> NgramModel:
    """Fits on at most ``sample_rows`` labelled documents outside the held-out fold, on all their buckets.

    The n-grams are taken where the texts are; one task then fits the bounded sample, and only
    the finished table (four bytes a bucket) comes to the driver.  With one class or no rows the
    model is constant.
    """
    sample = stash(labelled_sample(docs, labels, label_col, FOLDS, HELD_OUT, sample_rows, id_col, text_col), "sample")
    rows = sample.mapInArrow(_distinct, "doc_id long, label int, at array<int>")
    fitted = rows.repartition(1).sortWithinPartitions("doc_id", "label").mapInArrow(_fit, "intercept double, weights binary").first()
    if fitted is None:  # no rows, no task
        return NgramModel.constant(0.5)
    return NgramModel(np.frombuffer(fitted.weights, np.float32), fitted.intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no n-grams and get the intercept's score; texts of any length are
    scored whole.  A null id is
    never held out.  Repeated rows come back repeated, an empty table gives an empty result,
    and other columns are not looked at.  Without labelled rows every score is 0.5.
    """
    model = train(docs, labels, id_col, text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(x.as_py()) for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(fold(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
            F.col(text_col).alias("text"),
        )
        .mapInArrow(run, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )

"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One score for each document (shared weights of its words and their shapes, averaged over the text, and the share of
words that repeat the one before) is held against ordered thresholds: P(grade <= k) = logistic(threshold_k - score).
The expected grade ranks documents; the tail probability P(grade >= 1) selects them.

Grades from `labels`: 0 low quality, 1 good but toxic, 2 good. Rows without a quality label are not learnt from. Null and
empty texts have no words: they get grade 0 for certain and are not selected. Without any labelled document every text
is as likely good as not. Repeated rows come back as often as they came. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import table
from granary.llm.features import SLOTS, Adam, Weights, held_out, labelled_sample, slot, style_features

SAMPLE = 5000
GRADES = 3
REPEAT = slot("text", "repeats the word before")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def repeats(words: list[str]) -> int:
    """Words equal to the one before them."""
    return sum(map(str.__eq__, words[1:], words))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._words = Weights(weights, style_features)

    def score(self, text: str) -> float | None:
        words = text.split()
        if not words:
            return None
        return (sum(map(self._words.__getitem__, words)) + self.weights[REPEAT] * repeats(words)) / len(words)

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        z = self.score(text)
        return np.zeros(GRADES - 1) if z is None else _sigmoid(z - self.thresholds)


def loss_and_slopes(z: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of the grades at scores z, its slope in each score and in each threshold."""
    n, at = len(z), np.arange(len(z))
    tails = _sigmoid(z[:, None] - thresholds)
    # The likelihood of a grade is the difference of two neighbouring tails.
    upper = np.concatenate([np.ones((n, 1)), tails], axis=1)[at, grade]
    lower = np.concatenate([tails, np.zeros((n, 1))], axis=1)[at, grade]
    likely = np.maximum(upper - lower, 1e-9)
    slope = tails * (1 - tails)
    at_upper = np.concatenate([np.zeros((n, 1)), slope], axis=1)[at, grade]
    at_lower = np.concatenate([slope, np.zeros((n, 1))], axis=1)[at, grade]
    by_threshold = [(np.where(grade == k + 1, at_upper, 0.0) - np.where(grade == k, at_lower, 0.0)) @ (1 / likely) / n for k in range(len(thresholds))]
    return float(-np.log(likely).mean()), -(at_upper - at_lower) / likely / n, np.array(by_threshold)


def fit(sample: list[tuple[str, int]], grades: int = GRADES, steps: int = 150, rate: float = 0.3, shrink: float = 1e-5) -> Model:
    """Weights and ordered thresholds that make the sample's grades likely."""
    sample = [(t, y) for t, y in sample if t.split()]
    if not sample:
        return Model(np.zeros(SLOTS), np.zeros(grades - 1))
    known: dict[str, int] = {}
    tokens, docs, repeated = [], [], []
    for d, (text, _) in enumerate(sample):
        words = text.split()
        ids, counts = np.unique(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), return_counts=True)
        tokens.append(np.stack([ids, counts]) / np.array([[1], [len(words)]]))
        docs.append(np.full(len(ids), d))
        repeated.append(repeats(words) / len(words))
    (token, share), doc, repeat = np.concatenate(tokens, axis=1), np.concatenate(docs), np.array(repeated)
    token = token.astype(np.int64)
    features = np.array([style_features(w) for w in known], dtype=np.int32)
    grade = np.array([y for _, y in sample])
    n = len(sample)
    rates = np.array([np.clip((grade >= k).mean(), 0.01, 0.99) for k in range(1, grades)])
    weights, first, gaps = Adam(SLOTS, rate), Adam(1, 0.05), Adam(max(grades - 2, 0), 0.05)
    start = -np.log(rates / (1 - rates))
    first.value[:] = start[0]
    gaps.value[:] = np.log(np.maximum(np.diff(start), 0.05))
    for _ in range(steps):
        per_word = weights.value[features].sum(axis=1)
        z = np.bincount(doc, weights=per_word[token] * share, minlength=n) + weights.value[REPEAT] * repeat
        thresholds = first.value[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps.value))])
        _, g, by_threshold = loss_and_slopes(z, thresholds, grade)
        by_word = np.bincount(token, weights=g[doc] * share, minlength=len(known))
        gradient = sum(np.bincount(column, weights=by_word, minlength=SLOTS) for column in features.T)
        gradient[REPEAT] += g @ repeat
        weights.step(gradient + shrink * weights.value)
        later = np.cumsum(by_threshold[::-1])[::-1]
        first.step(np.array([later[0]]))
        if grades > 2:
            gaps.step(later[1:] * np.exp(gaps.value))
    return Model(weights.value, first.value[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps.value))]))


def grade_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, expected_grade (0 to GRADES - 1) and tail_probability, P(grade >= 1), of each whole text."""
    at = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.thresholds))  # at most SLOTS weights
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, thresholds = sent.value
        weights = np.zeros(SLOTS)
        weights[slots] = values
        own = Model(weights, thresholds)
        for batch in batches:
            tails = np.array([own.tails(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(thresholds))
            out = [*(batch.column(c) for c in names), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])]
            yield pa.RecordBatch.from_arrays(out, [*names, "expected_grade", "tail_probability"])

    schema = docs.select(*names).schema.add("expected_grade", "double").add("tail_probability", "double")
    return docs.select(*names).mapInArrow(graded, schema)


def grade_of_labels() -> Column:
    """0 low quality, 1 good but toxic, 2 good; null without a quality label."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull() & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality").isNotNull(), 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(labelled_sample(docs, labels, grade_of_labels(), sample))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = grade_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    keep = (F.col("tail_probability") >= 0.5).cast("int").alias("keep")
    return graded.select("doc_id", held_out().alias("held_out"), "expected_grade", F.col("tail_probability").alias("score"), keep)

"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is logistic in the hashed features of its words; a document is toxic unless none of its sentences is
(noisy-or: 1 - prod(1 - p)). The weights are learnt from the documents' labels through that product, on a bounded
sample of labelled rows; the sentences that offend are those with a high score of their own.

A sentence ends at a word that ends in . ! or ?, and after 40 words at the latest. Null and empty texts have no sentence
and score 0. Without any labelled document every score is 0. Repeated rows come back as often as they came. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import DOCUMENT_COLUMNS, table
from granary.llm.features import SLOTS, Adam, Weights, held_out, labelled_sample, word_features

SAMPLE = 5000
THRESHOLD = 0.3
MOST_WORDS = 40
ENDS = (".", "!", "?")


def sentence_starts(words: list[str]) -> np.ndarray:
    """Places in words where a sentence begins."""
    n = len(words)
    ends = np.fromiter((w[-1] in ENDS for w in words), bool, n)
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[1:] = ends[:-1]
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    return np.flatnonzero(since % MOST_WORDS == 0)


def _log_clean(scores: np.ndarray) -> np.ndarray:
    """log(1 - p) for logits."""
    return -np.logaddexp(0.0, scores)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._words = Weights(weights, word_features)

    def sentences(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, where sentences begin, and the sentences' logits."""
        words = text.split()
        if not words:
            return words, np.zeros(0, int), np.zeros(0)
        starts = sentence_starts(words)
        values = np.fromiter(map(self._words.__getitem__, words), float, len(words))
        return words, starts, np.add.reduceat(values, starts) + self.bias

    def score(self, text: str) -> float:
        return float(-np.expm1(_log_clean(self.sentences(text)[2]).sum())) + 0.0  # never -0.0


def loss_and_slopes(z: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of documents labelled `label`, whose sentences `doc` have logits z, and its slope in each logit."""
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    log_clean = np.maximum(np.bincount(doc, weights=_log_clean(z), minlength=len(label)), -40.0)
    clean = np.exp(log_clean)
    loss = -np.where(label, np.log(np.maximum(1.0 - clean, 1e-6)), log_clean).mean()
    # d loss / d z is p for clean documents, and -p * clean / (1 - clean) for toxic ones.
    return float(loss), np.where(label[doc], -p * (clean / np.maximum(1.0 - clean, 1e-6))[doc], p) / len(label)


def fit(sample: list[tuple[str, int]], steps: int = 80, rate: float = 0.2, pull: float = 1e-3) -> Model:
    """Weights that make the labels of the sample's documents likely under the noisy-or of their sentences."""
    sample = [(t, y) for t, y in sample if t.split()]
    if not sample:
        return Model(np.zeros(SLOTS), -np.inf)
    known: dict[str, int] = {}
    tokens, starts, docs, at = [], [], [], 0
    for d, (text, _) in enumerate(sample):
        words = text.split()
        tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        begin = sentence_starts(words)
        starts.append(begin + at)
        docs.append(np.full(len(begin), d, np.int32))
        at += len(words)
    token, start, doc = map(np.concatenate, (tokens, starts, docs))
    sentence = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, at)))
    features = np.array([word_features(w) for w in known], dtype=np.int32)
    label = np.array([y for _, y in sample], bool)
    usable = _telling(features, token, doc[sentence], label)
    weights, bias = Adam(SLOTS, rate, pull), Adam(1, rate)
    bias.value[:] = -6.0
    for _ in range(steps):
        per_word = weights.value[features].sum(axis=1)
        z = np.bincount(sentence, weights=per_word[token], minlength=len(start)) + bias.value[0]
        _, g = loss_and_slopes(z, doc, label)
        by_word = np.bincount(token, weights=g[sentence], minlength=len(known))
        gradient = sum(np.bincount(column, weights=by_word, minlength=SLOTS) for column in features.T)
        weights.step(np.where(usable, gradient * 100, 0.0))
        bias.step(np.array([g.sum() * 100]))
    return Model(weights.value, float(bias.value[0]))


def _telling(features: np.ndarray, token: np.ndarray, doc: np.ndarray, label: np.ndarray, least_docs: int = 5, least_z: float = 4.0) -> np.ndarray:
    """Whether each feature's documents are labelled otherwise than chance would have it: the rest only adds noise to sums."""
    seen, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for k, column in enumerate(features.T):
        new = (features[:, :k] != column[:, None]).all(axis=1)[token]  # short words are their own beginnings
        pairs = np.unique(column[token[new]].astype(np.int64) * len(label) + doc[new])
        seen += np.bincount(pairs // len(label), minlength=SLOTS)
        toxic += np.bincount(pairs // len(label), weights=label[pairs % len(label)], minlength=SLOTS)
    base = min(max(label.mean(), 1e-3), 1 - 1e-3)
    z = (toxic - seen * base) / np.sqrt(np.maximum(seen, 1) * base * (1 - base))
    return (seen >= least_docs) & (np.abs(z) >= least_z)


def _spread(model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights that aren't zero, small enough to go with every task."""
    at = np.flatnonzero(model.weights)
    return at, model.weights[at], model.bias


def _gathered(packed: tuple[np.ndarray, np.ndarray, float]) -> Model:
    weights = np.zeros(SLOTS)
    weights[packed[0]] = packed[1]
    return Model(weights, packed[2])


def score_documents(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """The columns of docs, and the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(_spread(model))  # at most SLOTS weights
    names = [c for c in docs.columns if c != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _gathered(sent.value)
        for batch in batches:
            scores = [own.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, column])

    schema = docs.select(*names).schema.add(column, "double")
    return docs.select(*names).mapInArrow(scored, schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, first_word, last_word (exclusive), sentence, score: the sentences that make documents toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(_spread(model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _gathered(sent.value)
        for batch in batches:
            found = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words, starts, z = own.sentences(text or "")
                ends = np.append(starts[1:], len(words))
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                found += [(row, int(b), int(e), " ".join(words[b:e]), float(x)) for b, e, x in zip(starts, ends, p, strict=True) if x >= least]
            rows, *rest = zip(*found, strict=True) if found else ([],) * 5
            types = (pa.int32(), pa.int32(), pa.string(), pa.float64())
            arrays = [pa.array(list(x), t) for x, t in zip(rest, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(list(rows), pa.int64())), *arrays], ["doc_id", "first_word", "last_word", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(located, f"doc_id {kind}, first_word int, last_word int, sentence string, score double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(labelled_sample(docs, labels, F.col("toxic").cast("int"), sample))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' columns of the documents that score below the threshold."""
    scored = score_documents(docs.select(*DOCUMENT_COLUMNS), train(docs, labels))
    return scored.filter(F.col("toxicity") < threshold).select(*DOCUMENT_COLUMNS)

"""Hashed features of words, and the bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 18
#: What the texts of a sample may have in all.
SAMPLE_BYTES = 64 << 20
_EDGE = re.compile(r"^\W+|[\W_]+$")
_RUN = re.compile(r"(.)\1+")


def slot(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind} {text}".encode()) % SLOTS


#: The checksums of what stands before the text in `slot`, from which it goes on.
_WORD, _HEAD4, _HEAD5, _SHAPE = (zlib.crc32(f"{kind} ".encode()) for kind in ("word", "head4", "head5", "shape"))


def core(word: str) -> str:
    """The word in lower case, without marks at its ends; the word itself where nothing is left."""
    if word.isalnum():
        return word.lower()
    return _EDGE.sub("", word).lower() or word


def shape(word: str) -> str:
    """The word's kinds of characters, runs drawn together: A upper, a lower or other letter, 0 digit, else itself."""
    if word.isalpha() and word.islower():
        return "a"
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def word_features(word: str) -> tuple[int, int, int]:
    """The word and its beginnings: 4 and 5 letters, which inflected and joined forms share."""
    w = core(word)
    whole = zlib.crc32(w.encode(), _WORD) % SLOTS
    return whole, zlib.crc32(w[:4].encode(), _HEAD4) % SLOTS if len(w) > 4 else whole, zlib.crc32(w[:5].encode(), _HEAD5) % SLOTS if len(w) > 5 else whole


def style_features(word: str) -> tuple[int, int]:
    """The word and its shape."""
    return zlib.crc32(core(word).encode(), _WORD) % SLOTS, zlib.crc32(shape(word).encode(), _SHAPE) % SLOTS


class Weights(dict):
    """For each word seen, the sum of its features' weights; a bounded number of words, none of them long, is kept."""

    KEPT, LONGEST = 500_000, 64

    def __init__(self, weights: np.ndarray, features: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self._weights, self._features = array("d", weights), features

    def __missing__(self, word: str) -> float:
        weights = self._weights
        value = sum([weights[i] for i in self._features(word)])
        if len(word) <= self.LONGEST:
            if len(self) > self.KEPT:
                self.clear()
            self[word] = value
        return value


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, bound: int, bytes_bound: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `bound` pairs (text, label) of rows that may be learnt from, the same at every run: the rows whose hashed
    id comes first, each id once (with the text of the smallest hash), as long as their texts have no more than
    `bytes_bound` bytes in all. A document with several labels takes the largest; null labels, ids and texts don't count."""
    known = labels.select(F.col("doc_id"), label.alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    size, tie = F.octet_length("text").alias("size"), F.xxhash64("text").alias("tie")
    texts = docs.filter(F.col("text").isNotNull() & ~held_out()).select("doc_id", size, tie).groupBy("doc_id").agg(F.min(F.struct("tie", "size")).alias("t"))
    hashed = texts.join(known, "doc_id").select("doc_id", "y", "t.tie", "t.size", F.xxhash64("doc_id").alias("_h"))
    # Ids are chosen without their texts; the chosen ones, no more than the bound, go to where the texts are.
    first = hashed.orderBy("_h", "doc_id").limit(bound)
    upto = F.sum("size").over(Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_upto", upto).filter(F.col("_upto") <= bytes_bound).select("doc_id", "y", "tie")
    rows = docs.select("doc_id", "text").filter("text is not null").withColumn("tie", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "tie"])
    found = {(r.doc_id, r.text): r.y for r in rows.select("doc_id", "text", "y").dropDuplicates(["doc_id"]).collect()}
    return [(text, y) for (_, text), y in sorted(found.items())]


class Adam:
    """Gradient steps of adaptive length for one array, with an L1 pull towards zero."""

    def __init__(self, shape: tuple[int, ...] | int, rate: float, pull: float = 0.0):
        self.value = np.zeros(shape)
        self._m, self._v, self._t = np.zeros(shape), np.zeros(shape), 0
        self._rate, self._pull = rate, pull

    def step(self, gradient: np.ndarray) -> None:
        self._t += 1
        self._m += 0.1 * (gradient - self._m)
        self._v += 0.01 * (gradient**2 - self._v)
        self.value -= self._rate * (self._m / (1 - 0.9**self._t)) / (np.sqrt(self._v / (1 - 0.99**self._t)) + 1e-8)
        if self._pull:
            self.value = np.sign(self.value) * np.maximum(np.abs(self.value) - self._rate * self._pull, 0.0)

"""Packing documents into training sequences along a space-filling curve.

Each document's token ids are hashed into a vector of signed counts, projected to a few dimensions and placed on a
Hilbert curve. Documents are range-sorted by their place, and one running sum of their tokens along the curve gives each
its first position; the sequences are the stretches of `length` positions. Neighbours on the curve, alike in their
words, so share sequences, every sequence but the last few is full, and what is left over at the end goes into sequences
whose lengths are powers of two, which need no padding.

Documents are tokenized once, into a table in the shared folder; sorting moves only (key, row, tokens).

Null and empty texts are documents of one token (the end token). Repeated rows, and rows that share a doc_id or have
none, are separate documents. No rows give no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.token_counts import tokenizer_path

MODEL = "word_bpe_49k.json"
LENGTH = 4096
END = 2
BUCKETS, DIMENSIONS, BITS = 256, 4, 12
#: What words and what word parts a worker keeps from text to text, in bytes, with ENTRY for each one's objects.
BYTES_KEPT, ENTRY = 96 << 20, 150
DOCS_AT_ONCE = 512
#: Words of ASCII and Latin letters, which one rule cuts (in lower case) as the vocabulary's own does (fixed value).
LATIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")


class _Kept(dict):
    """Ids, two bytes each, of what was asked for; emptied when it holds more than BYTES_KEPT."""

    def __init__(self, encode: Callable):
        super().__init__()
        self._encode, self._bytes = encode, 0

    def __missing__(self, key: str | bytes) -> bytes:
        if self._bytes > BYTES_KEPT:
            self.clear()
            self._bytes = 0
        ids = self[key] = self._encode(key)
        self._bytes += len(key) + len(ids) + ENTRY
        return ids


class WordTokenizer:
    """Token ids of texts, word by word: blanks never join words, so that a text's ids are its words' ids in a row.

    Words are cut into parts by the library's own steps (Latin words by their rule), and parts are merged by its
    model; a word that may hold a special token goes through the library as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model, self._normalizer, self._cutter = self._library.model, self._library.normalizer, self._library.pre_tokenizer
        if self._library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        letters = [chr(x) for x in range(0xC0, 0x250)]
        self._bytes = {ord(x): "".join(part for part, _ in self._cutter.pre_tokenize_str(x)) for x in letters}
        self._parts, self._words = _Kept(self._of_part), _Kept(self._of_word)

    def _of_part(self, part: str) -> bytes:
        return b"".join([t.id.to_bytes(2, "little") for t in self._model.tokenize(part)])

    def _of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text:
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if LATIN.fullmatch(text):
            parts = PARTS.findall(text.lower())
            if not text.isascii():
                parts = [part.translate(self._bytes) for part in parts]
        else:
            parts = [part for part, _ in self._cutter.pre_tokenize_str(self._normalizer.normalize_str(text))]
        return b"".join(map(self._parts.__getitem__, parts))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids, two bytes each, with the end token."""
        ids, end = self._words.__getitem__, np.array([END], "<u2").tobytes()
        return [b"".join(map(ids, t.split())) + end for t in texts]  # bytes split at the six ASCII blanks only


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.cache
def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(buckets, dimensions))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2 ** bits, one row each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrorings of each level, from the coarsest
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The curve places of documents given by their token ids."""
    mixed = np.concatenate(ids).astype(np.uint32) * np.uint32(2654435761)
    slots = np.repeat(np.arange(len(ids)) * BUCKETS, [len(x) for x in ids]) + (mixed >> 24)
    signs = 1.0 - 2.0 * ((mixed >> 23) & 1)
    vectors = np.bincount(slots, weights=signs, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    norms = np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)
    placed = vectors / norms @ projection()
    return hilbert_keys(np.clip((placed + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (two bytes each, end token included), tokens, key on the curve."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path(model))
        for whole in batches:
            for first in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(first, DOCS_AT_ONCE)
                ids = words.encode([t or b"" for t in batch.column("text").to_pylist()])
                arrays = [np.frombuffer(x, "<u2") for x in ids]
                out = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(a) for a in arrays], pa.int64()), pa.array(curve_keys(arrays))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "tokens", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {kind}, ids binary, tokens long, key long")


def positions(rows: DataFrame) -> DataFrame:
    """row, first (position along the curve) and all (tokens of all rows), from key, row and tokens."""

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, part = 0, TaskContext.get().partitionId()
        for frame in frames:
            ends = before + frame["tokens"].cumsum()
            yield pd.DataFrame({"row": frame["row"], "part": part, "tokens": frame["tokens"], "first": ends - frame["tokens"]})
            before = int(ends.iloc[-1]) if len(ends) else before

    in_order = rows.select("key", "row", "tokens").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    local = stored(in_order.mapInPandas(running, "row long, part int, tokens long, first long"), "pack-order")
    # One row for each partition of the sort.
    parts = local.groupBy("part").agg(F.sum("tokens").alias("here"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"), F.sum("here").over(Window.partitionBy(F.lit(0))).alias("all"))
    return local.join(parts, "part").select("row", (F.col("first") + F.col("base")).alias("first"), "all")


def _bounds(all_tokens: int, length: int) -> np.ndarray:
    """Where the sequences after the last full one begin, and the end: powers of two, longest first."""
    rest, at, out = all_tokens % length, all_tokens // length * length, []
    for k in range(length.bit_length(), -1, -1):
        if rest >> k & 1:
            out.append(at)
            at += 1 << k
    return np.array([*out, all_tokens])


def pieces_of(first: int, n: int, all_tokens: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document whose n tokens begin at position first."""
    full = all_tokens // length
    cuts = np.arange(first // length + 1, min((first + n - 1) // length, full) + 1) * length
    tail = _bounds(all_tokens, length)
    cuts = np.unique(np.concatenate(([first], cuts, tail[(tail > first) & (tail < first + n)], [first + n])))
    out = []
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b < full * length:
            sequence, begin = b // length, b // length * length
        else:
            k = int(np.searchsorted(tail, b, side="right")) - 1
            sequence, begin = full + k, int(tail[k])
        out.append((b - first, e - b, sequence, b - begin))
    return out


def pack(docs: DataFrame, length: int = LENGTH, model: str = MODEL) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = stored(tokenized(docs, model).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    placed = rows.select("doc_id", "ids", "row").join(positions(rows).hint("merge"), "row")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for at, (ids, first, every) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "first", "all")), strict=True)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for start, n, sequence, offset in pieces_of(first, len(wide), every, length):
                    found.append((at, start, n, zlib.crc32(wide[start : start + n].tobytes()), len(wide), sequence, offset))
            at, *numbers = np.array(found, dtype=np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *map(pa.array, numbers)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "ids", "first", "all").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

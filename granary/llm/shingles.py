"""Sets of hashed word shingles, computed over a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19
_BLANKS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    """A random value for each byte, the same for A-Z and a-z, 0 for blanks."""
    values = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[_BLANKS] = 0
    return values


_VALUES = _byte_values()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word; bounds: where texts begin in data, and its end."""
    solid = _VALUES[data] != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.full(int(place.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    hashes = np.add.reduceat(_VALUES[data] * powers[place], starts)
    return mixed(hashes), np.searchsorted(bounds, starts, side="right") - 1


def _joined(words: list[np.ndarray]) -> np.ndarray:
    """The hash of sequences of words, given as columns; sequences of different lengths differ."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = (out ^ (out >> np.uint64(29))) * _STEP + w
    return mixed(out)


def _sets_of(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in a row, and where each text's begin."""
    n = len(bounds) - 1
    hashes, text = _word_hashes(data, bounds)
    counts = np.bincount(text, minlength=n)
    keys, owners = [], []
    if len(hashes) >= size:
        inside = text[: len(text) - size + 1] == text[size - 1 :]
        keys.append(_joined([hashes[j : len(hashes) - size + 1 + j] for j in range(size)])[inside])
        owners.append(text[: len(text) - size + 1][inside])
    first = np.cumsum(counts) - counts
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            keys.append(_joined([hashes[first[short] + j] for j in range(k)]))
            owners.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(n + 1))


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its set: distinct shingles of `size` words (A-Z in lower case); with fewer
    words the whole sequence as one; none for a null text or one without words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        keys, begins = _sets_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size)
        for i in range(last - first):
            yield keys[begins[i] : begins[i + 1]]
        first = last


def set_hash(keys: np.ndarray) -> int:
    """One number for a set, the same for equal sets."""
    both = np.array([np.bitwise_xor.reduce(keys) if len(keys) else 0, (mixed(keys ^ _STEP)).sum(dtype=np.uint64)], np.uint64)
    return int(_joined([both[:1], both[1:], np.array([len(keys)], np.uint64)])[0].astype(np.int64))


def to_planes(keys: np.ndarray) -> bytes:
    """Sorted keys cut to their upper 48 bits, byte by byte of all keys, highest first: the first bytes compress well."""
    return np.ascontiguousarray((keys >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def slices(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without nulls, not copied."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    return [data[b:e] for b, e in zip(offsets[:-1], offsets[1:], strict=True)]


def from_planes(planes: bytes | memoryview) -> np.ndarray:
    """Sorted 48-bit keys."""
    six = np.frombuffer(planes, np.uint8).reshape(6, -1)
    wide = np.zeros((six.shape[1], 8), np.uint8)
    wide[:, 2:] = six.T
    return wide.view(">u8").ravel().astype(np.int64)

import collections
import zlib

import numpy as np
import pytest
from granary.llm.packing import MODEL, WordTokenizer, hilbert_keys, pack, pieces_of
from granary.llm.token_counts import tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(tokenizer_path(MODEL))
WORDS = WordTokenizer(tokenizer_path(MODEL))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abT 's\té\x0b\x85Σİ日½1.!😀ﬁ́") + ["don't ", "<|endoftext|>", "<|startoftext|>"]), max_size=40).map("".join))
def test_word_ids_equal_the_library(text):
    ids = np.frombuffer(WORDS.encode([text.encode()])[0], "<u2").tolist()
    assert ids == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("dimensions", [2, 3, 4])
def test_neighbours_on_the_curve_are_neighbours_in_space(dimensions):
    points = np.stack(np.meshgrid(*[np.arange(8)] * dimensions), axis=-1).reshape(-1, dimensions)
    keys = hilbert_keys(points, 3)
    assert sorted(keys) == list(range(len(points)))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


@pytest.mark.parametrize("all_tokens", [1, 5, 8, 16, 29, 64])
def test_pieces_cover_every_position_once(all_tokens):
    for first in range(all_tokens):
        n = min(11, all_tokens - first)
        pieces = pieces_of(first, n, all_tokens, 8)
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist() and sum(p[1] for p in pieces) == n


def test_sequences(documents):
    texts = [None, "", *(" ".join(f"w{(i * j) % 17}" for j in range(i * 7)) for i in range(60)), "same text", "same text", "long " * 3000]
    rows = [(i if i % 9 else None, t, "s") for i, t in enumerate(texts)]
    out = pack(documents(rows), length=256).collect()
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(covered[i] == sum(map(len, x)) for i, x in ids.items())
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert sum(sum(n for _, n in p) == 256 for p in sequences.values()) >= len(sequences) - 8
    assert pack(documents(texts).limit(0)).count() == 0


def test_clashing_columns(documents):
    docs = documents(["a b", "c", None]).withColumns({c: F.lit(1) for c in ("ids", "tokens", "key", "row", "first", "all", "part", "start", "length")})
    out = pack(docs, length=8)
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2] and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_kept_words_are_bounded(monkeypatch):
    from granary.llm import packing

    monkeypatch.setattr(packing, "BYTES_KEPT", 2000)
    words = WordTokenizer(tokenizer_path(MODEL))
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(20)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]
    assert len(words._words) < 40

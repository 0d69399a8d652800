import random
import re
from collections import Counter

import numpy as np
import pytest
from granary.llm import phrases
from granary.llm.phrases import Counting, collocations
from pyspark.sql import functions as F

CAPITALS = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30):
    out = []
    by_lang = {}
    for text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append((text or "").translate(CAPITALS))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for k in range(1, 5):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"É{i}" for i in range(60)]
    fixed = ["new york city hall", "machine learning", "One Two three", "see also"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words[: rng.choice([3, 60])]))
            parts.append(rng.choice([" "] * 12 + ["\t", ". ", ",", "\n", "\r\n", "; ", "  ", "-", "\x0b"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return rows


def frame(spark, rows):
    extra = {c: F.lit(1) for c in ("next", "f", "word", "words", "segment", "n", "k", "rank", "following")}
    return spark.createDataFrame(rows, "text string, lang string").withColumns(extra)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_phrases_equal_a_plain_version(spark):
    """Runs of one word, repeated rows, null and empty texts, null languages and one that is named as they are."""
    rows = [*texts(1, 500), (None, "en"), ("", "en"), ("   ", None), ("a " * 5000, "en"), ("!?", "fr"), ("one", "fr")]
    rows += [("the same text in each row", "es")] * 40
    want = plain(rows)
    assert {len(w[2].split()) for w in want} == {2, 3, 4} and ("es", 1, "same text in each", 40, 40, 40, 240, 1_000_000) in want
    assert got(collocations(frame(spark, rows))) == want


def test_stretches_segments_and_full_filters_change_nothing(spark):
    rows = [*texts(2, 200), (" and ".join(t for t, _ in texts(3, 60)), "en")]
    want = plain(rows)
    assert got(collocations(frame(spark, rows), Counting(stretch=64, together=100, filter_bits=6, most_hot=1 << 30, least_hot=50))) == want


def test_words_that_share_a_hash_are_counted_anew(spark):
    how = Counting(values=lambda seed: np.minimum(phrases.byte_values(seed), np.uint64(1 if seed == 0 else (1 << 64) - 1)))
    rows = [("ab cd", "en")] * 40
    assert phrases.vocabulary(frame(spark, rows), 0, how).filter("word <> other").count() == 1
    assert got(collocations(frame(spark, rows), how)) == plain(rows)


def test_only_the_first_of_a_language(spark, monkeypatch):
    rows = texts(4, 300)
    want = plain(rows)
    monkeypatch.setattr(phrases, "FIRST", 3)
    assert got(collocations(frame(spark, rows))) == [w for w in want if w[1] <= 3]


def test_no_rows(spark):
    assert got(collocations(frame(spark, [("a b", "en")]).limit(0))) == []
    assert got(collocations(frame(spark, [(None, None), ("", "en")]))) == []


def test_stripes_are_merged_without_another_shuffle(spark):
    docs = frame(spark, texts(5, 50))
    sc = spark.sparkContext
    merged = phrases._striped(docs, 0, Counting(), 2, 1000, sc.broadcast(np.full(1 << Counting.filter_bits - 5, 0xFFFFFFFF, np.uint32)), sc.broadcast((np.zeros(0, np.int64),) * 2))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(3))
def test_words_and_pieces_of_a_stretch(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("aB .,\t\né") for _ in range(rng.randrange(1, 30))).encode() for _ in range(20)]
    heads = np.cumsum([0, *map(len, parts)])[:-1]
    h, starts, ends, pieces = phrases._words(np.frombuffer(b"".join(parts), np.uint8), phrases.byte_values(0), heads)
    want = [(i, j, w) for i, p in enumerate(parts) for j, piece in enumerate(re.split(rb"[.,\n]", p.lower())) for w in piece.split()]
    raw = b"".join(parts).lower()
    assert [raw[b:e] for b, e in zip(starts, ends)] == [w for *_, w in want]
    assert [a == b for a, b in zip(pieces, pieces[1:])] == [a[:2] == b[:2] for a, b in zip(want, want[1:])]
    assert [[a == b for b in h] for a in h] == [[a[2] == b[2] for b in want] for a in want]

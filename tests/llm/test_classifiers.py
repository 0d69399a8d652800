import math
import random
import re
import zlib

import numpy as np
import pytest
from granary.llm import quality, toxicity
from granary.llm.features import SLOTS, labelled_sample, shape, word_features
from pyspark.sql import functions as F

BAD = ["scum", "trash", "idiotic", "vermin"]


@pytest.fixture(scope="module")
def corpus():
    random.seed(4)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        text = [random.choice(words) + random.choice(["", "", "", "."]) for _ in range(random.randint(20, 120))]
        toxic = i % 5 == 0
        junk = i % 7 == 0
        for _ in range(3 if toxic else 0):
            text[random.randrange(len(text))] = random.choice(BAD)
        if junk:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def frames(spark, documents, corpus):
    rows, labels = corpus
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark, documents, corpus):
    docs, labels = frames(spark, documents, corpus)
    model = toxicity.train(docs, labels)
    truth = {i: t for i, _, t in corpus[1]}
    scored = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in truth if is_held_out(i)]
    assert sum((scored[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held) / len(held) > 0.95
    found = toxicity.offending_sentences(docs, model).collect()
    assert sum(any(b in r.sentence for b in BAD) for r in found) / len(found) > 0.9
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.7 * len(truth) < kept.count() < 0.9 * len(truth)


def test_toxicity_edge_cases(spark, documents, corpus):
    docs, labels = frames(spark, documents, corpus)
    model = toxicity.fit([])
    odd = documents([None, "", " ", "word " * 20000]).withColumnRenamed("n_chars", "toxicity")
    assert [r.toxicity for r in toxicity.score_documents(odd, model).collect()] == [0.0] * 4
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).bias == float("-inf")
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None), (1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, nulls)


def test_quality_on_held_out_documents(spark, documents, corpus):
    docs, labels = frames(spark, documents, corpus)
    model = quality.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    truth = {i: q for i, q, _ in corpus[1]}
    graded = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    held = [i for i in truth if is_held_out(i)]
    assert sum((graded[i].tail_probability >= 0.5) == bool(truth[i]) for i in held) / len(held) > 0.97
    assert all(0 <= r.expected_grade <= 2 for r in graded.values())


def test_quality_edge_cases(documents):
    model = quality.fit([])
    rows = quality.grade_documents(documents([None, "", "a b"]), model).collect()
    assert [r.tail_probability for r in rows] == [0.0, 0.0, 0.5]
    assert quality.grade_documents(documents(["a"]).limit(0), model).count() == 0


def test_features():
    assert shape("THE!!") == "A!" and shape("Word***") == "Aa*" and shape("12.5") == "0.0"
    assert word_features("Trash,")[0] == word_features("trash")[0]


def plain_features(word):
    w = re.sub(r"^\W+|[\W_]+$", "", word).lower() or word
    at = lambda kind, text: zlib.crc32(f"{kind} {text}".encode()) % SLOTS
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return (at("word", w), at("head4", w[:4]) if len(w) > 4 else at("word", w), at("head5", w[:5]) if len(w) > 5 else at("word", w)), (at("word", w), at("shape", re.sub(r"(.)\1+", r"\1", kinds)))


def test_scores_equal_the_plain_version():
    random.seed(8)
    texts = [" ".join(random.choice(["Good", "bad.", "x_", "__", "Ünder!", "a-b", "12,5", "word" * 30, "..."]) for _ in range(random.randint(0, 130))) for _ in range(60)]
    weights = np.random.default_rng(2).normal(size=SLOTS)
    toxic, good = toxicity.Model(weights, -0.5), quality.Model(weights, np.array([-0.2, 0.4]))
    for text in texts:
        words = text.split()
        sentences, clean, total = [[]], 1.0, 0.0
        for i, word in enumerate(words):
            sentences[-1].append(sum(weights[s] for s in plain_features(word)[0]))
            total += sum(weights[s] for s in plain_features(word)[1]) + (weights[quality.REPEAT] if i and word == words[i - 1] else 0.0)
            if word[-1] in ".!?" or len(sentences[-1]) == 40:
                sentences.append([])
        for s in filter(None, sentences):
            clean *= 1 / (1 + math.exp(sum(s) - 0.5))
        assert abs(toxic.score(text) - (1 - clean)) < 1e-9
        want = [1 / (1 + math.exp(t - total / len(words))) for t in (-0.2, 0.4)] if words else [0.0, 0.0]
        assert np.allclose(good.tails(text), want)
    assert math.copysign(1, toxic.score("")) == 1


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(3)
    z, doc, label = rng.normal(size=30), np.sort(rng.integers(0, 9, 30)), rng.random(9) < 0.5
    _, slopes = toxicity.loss_and_slopes(z, doc, label)
    step = 1e-6 * np.eye(30)
    assert np.allclose([(toxicity.loss_and_slopes(z + d, doc, label)[0] - toxicity.loss_and_slopes(z - d, doc, label)[0]) / 2e-6 for d in step], slopes, atol=1e-6)
    grade, thresholds = rng.integers(0, 3, 30), np.array([-0.3, 0.8])
    _, by_score, by_threshold = quality.loss_and_slopes(z, thresholds, grade)
    loss = lambda x, t: quality.loss_and_slopes(x, t, grade)[0]
    assert np.allclose([(loss(z + d, thresholds) - loss(z - d, thresholds)) / 2e-6 for d in step], by_score, atol=1e-6)
    assert np.allclose([(loss(z, thresholds + d) - loss(z, thresholds - d)) / 2e-6 for d in 1e-6 * np.eye(2)], by_threshold, atol=1e-6)


def test_the_sample_is_one_at_every_run(spark, documents, corpus):
    rows = [*corpus[0], *[(i, t + " again", s) for i, t, s in corpus[0][:50]], *corpus[0][:20], (None, "no id", "s"), (1, None, "s")]
    labels = spark.createDataFrame(corpus[1] * 2, "doc_id long, quality int, toxic int")
    runs = [labelled_sample(documents(order), labels, F.col("toxic"), 40) for order in (rows, rows[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 40
    few = labelled_sample(documents(rows), labels, F.col("toxic"), 40, bytes_bound=3000)
    assert 0 < len(few) < 40 and sum(len(t) for t, _ in few) <= 3000


def test_clashing_columns_and_repeated_rows(spark, documents, corpus):
    docs, labels = frames(spark, documents, corpus)
    odd = docs.limit(20).unionByName(docs.limit(20)).withColumns({c: F.lit(1) for c in ("y", "tie", "size", "expected_grade", "tail_probability", "toxicity", "_h")})
    assert toxicity.score_documents(odd, toxicity.train(odd, labels)).count() == 40
    graded = quality.grade_documents(odd, quality.train(odd, labels))
    assert graded.count() == 40 and dict(graded.dtypes)["expected_grade"] == "double" and "y" in graded.columns

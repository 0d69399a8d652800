import random
import re

import numpy as np
import pyarrow as pa
import pytest
from granary.llm import near_duplicates as nd
from granary.llm.components import connected_components
from granary.llm.shingles import from_planes, set_hash, shingle_sets, to_planes
from pyspark.sql import functions as F


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
    return words


def corpus(seed):
    """Copies, near copies around a base that need not link with each other, chains of edits, shared passages, short texts."""
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    new = lambda n: [random.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n ", "One", "one", "a b c", "A b\tc", "x x x x x x x x"]
    base = new(90)
    texts += [" ".join(edited(base, random.choice([0, 1, 1, 2, 2, 3]))) for _ in range(120)]
    chain = new(60)
    for _ in range(15):
        chain = edited(chain, 1)
        texts.append(" ".join(chain))
    passage = new(40)
    texts += [" ".join(new(random.choice([5, 20, 100])) + passage + new(10)) for _ in range(60)]
    common = new(30)
    texts += [" ".join(common + new(random.choice([3, 30, 90]))) for _ in range(200)]
    texts += [" ".join(new(random.randint(1, 200))) for _ in range(60)]
    texts += random.choices(texts, k=40)
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("dear", [nd.DEAR, 0.5])
def test_components_equal_the_plain_version(documents, monkeypatch, dear):
    monkeypatch.setattr(nd, "DEAR", dear)
    texts = corpus(int(dear))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(documents(texts)).collect()}
    assert out == plain(texts)


def test_copies_over_many_files(documents):
    """A batch of the stored sets spans files that are not in the order of their rows."""
    random.seed(11)
    texts = []
    for _ in range(30):
        base = [f"w{random.randrange(10**6)}" for _ in range(random.randint(30, 60))]
        texts += [" ".join(base)] * 12 + [" ".join(edited(base, 1))] * 12
    random.shuffle(texts)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(documents(texts).repartition(24)).collect()}
    assert out == plain(texts)


def test_one_of_each(documents):
    texts = ["a b c d e f g", "A b c d e f g", None, "", "other words stand here", "a b c d e f g"]
    out = nd.one_of_each(documents(texts))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4] and len(out.columns) == 5
    ids = [(None, "a b c d e f", "s"), (7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (9, "a b c d e f", "s"), (7, "A b c d e f", "s")]
    ids += [(None, "no id at all here", "s"), (None, "no id at all here", "t"), (None, None, "s"), (None, None, "s"), (7, "other words of one id", "s")]
    out = sorted((str(r.doc_id), str(r.text).lower()) for r in nd.one_of_each(documents(ids)).collect())
    assert out == [("7", "a b c d e f"), ("7", "other words of one id"), ("None", "no id at all here"), ("None", "none")]
    clashing = documents(ids).withColumns({c: F.lit(1) for c in ("row", "tie", "n", "sig", "planes", "group", "key")})
    assert nd.one_of_each(clashing).count() == 4 and nd.near_duplicates(clashing).count() == len(ids)


def test_no_rows_and_no_links(documents):
    assert nd.near_duplicates(documents(["a"]).limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in nd.near_duplicates(documents(["a b", "c d", None])).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_shingle_sets():
    random.seed(3)
    texts = [" ".join(random.choice(["a", "B", "b", "cé", "dd"]) for _ in range(random.randint(0, 30))) for _ in range(200)] + [None, "", "\t", "x" * 3_000_000]
    got, want = list(shingle_sets(pa.array(texts))), [plain_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for _ in range(500):
        i, j = random.randrange(len(texts)), random.randrange(len(texts))
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
        assert (set_hash(got[i]) == set_hash(got[j])) == (want[i] == want[j])
    assert (from_planes(to_planes(got[3])) == (got[3] >> np.uint64(16)).astype(np.int64)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (70, 71)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40, 70: 70, 71: 70}

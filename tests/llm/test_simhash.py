import random
from itertools import combinations

import xxhash
from granary.llm import simhash
from granary.llm.components import connected_components
from granary.llm.simhash import fingerprint, simhash_components
from pyspark.sql import functions as F

CAPITALS = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANKS = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "").translate(CAPITALS) + " ":
        if c in BLANKS:
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """{item: least item reachable} for (item, fingerprint) pairs."""
    name = dict.fromkeys(range(len(items)))
    root = list(range(len(items)))
    for i, j in combinations(range(len(items)), 2):
        if bin(items[i][1] ^ items[j][1]).count("1") <= 3:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    for r in set(root):
        ids = [items[i][0] for i in name if root[i] == r and items[i][0] is not None]
        for i in name:
            if root[i] == r:
                name[i] = min(ids, default=None)
    return name


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"wort{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([4, 30, 400]))]
        for _ in range(rng.choice([0, 0, 4])):
            copy = list(text)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(rng.choice([" ", "\t", "\r\n", "  "]).join(text))
    return texts


def test_components_equal_a_plain_version(spark, documents):
    texts = [*near_copies(1, 60), None, "", "   ", "one", "ONE", "one two", "Éa b c", "éa b c", "x " * 30_000, "same text again here"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "same text again here", "s"), (None, "lonely words that nothing else holds", "s"), (3, texts[3], "s"), (7, "another text of the same id", "s")]
    docs = documents(rows).withColumns({c: F.lit(1) for c in ("fp", "list", "shared", "least", "component", "node", "point")})
    items = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    names = plain_components(items)
    want = sorted(((i, f"{fp:016x}", names[k]) for k, (i, fp) in enumerate(items)), key=repr)
    assert sorted((tuple(r) for r in simhash_components(docs).collect()), key=repr) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_fingerprint_counts_stretches_and_repeats(monkeypatch):
    text = " ".join(f"w{i % 13}" for i in range(500))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_hashes_are_those_of_spark(spark):
    assert spark.sql("SELECT xxhash64('one word é') AS h").first().h % (1 << 64) == xxhash.xxh64_intdigest("one word é".encode(), 42)


def test_dense_lists_join_all_that_links(spark):
    """Hundreds of fingerprints around one another: no pair is emitted, and the components are those of all pairs."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(16, 26), rng.randrange(5))) for b in base for _ in range(250)}
    fps |= {b ^ sum(1 << x for x in rng.sample(range(64), 7)) for b in base}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    lists = simhash._lists(spark.createDataFrame([(f,) for f in fps], "fp long")).persist()
    assert lists.filter("not by_pairs").count() > 1000
    edges = simhash._pairs(lists).unionByName(simhash._around_points(lists))
    assert edges.count() <= 56 * len(fps)  # the points around a member where 10 bits vary
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components([(f, f % (1 << 64)) for f in fps])
    assert [got.get(f, f) for f in fps] == [want[i] for i in range(len(fps))]


def test_every_guaranteed_pair_shares_a_key():
    for bits in combinations(range(8), 3):
        changed = sum(0xFF << 8 * b for b in bits)
        assert any((k % (1 << 64)) & changed == 0 for k in simhash.KEYS)


def test_no_rows(spark, documents):
    assert simhash_components(documents(["a b c"]).limit(0)).count() == 0

import collections

import xxhash
from granary.llm.mixing import DOCS_A_BUCKET, Mix, in_shards, mix_counts, mix_documents, permuted, shard_counts, slots, source_targets, sized
from pyspark.sql import functions as F


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


def hashed(*values):
    """The engine's 64-bit hash of a row of whole numbers and strings; nulls leave it as it was."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True))
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def int4(x):
    return x.to_bytes(4, "little", signed=True)


def plain_permuted(x, n, key, rounds=24):
    for r in range(1, rounds + 1):
        partner = (hashed(key, int4(r)) % n - x) % n
        if hashed(key, int4(-r), max(x, partner)) % 2 == 0:
            x = partner
    return x


def plain_mix(rows, mix):
    """For each row: words taken, slots that take some, their least and greatest shard; everything word by word."""
    sizes, of_source = [len((t or "").split()) for _, t, _ in rows], collections.defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        of_source[s].append(i)
    total = {s: sum(sizes[i] for i in of) for s, of in of_source.items()}
    target, buckets = plain_targets(total), max(1, len(rows) // DOCS_A_BUCKET)
    found = {i: (0, []) for i in range(len(rows))}
    order = sorted(total, key=lambda s: (s is None, s.encode() if s is not None else b""))
    take = {s: min(round(target[s] + 1e-12), int(2 * total[s])) for s in order}
    blocks = {s: -(-total[s] // mix.block) for s in order}
    slots = {s: take[s] // total[s] * blocks[s] + -(-(take[s] % total[s]) // mix.block) if total[s] else 0 for s in order}
    first = 0
    for s in order:
        key = "null" if s is None else "=" + s
        at = sorted(of_source[s], key=lambda i: (hashed(rows[i][0]) % buckets, rows[i][0], hashed(rows[i][0], rows[i][1]), sizes[i]))
        owner = [i for i in at for _ in range(sizes[i])]
        for slot in range(slots[s]):
            turn, k = divmod(slot, blocks[s])
            whole = total[s] // mix.block
            block = plain_permuted(k, whole, hashed(int4(mix.seed), key, turn)) if k < whole else whole
            here = owner[block * mix.block : (block + 1) * mix.block]
            if turn == take[s] // total[s]:
                here = here[: take[s] % total[s] - k * mix.block]
            shard = plain_permuted(first + slot, sum(slots.values()), hashed(int4(mix.seed), "shards")) // mix.shard_slots
            for i, n in collections.Counter(here).items():
                found[i] = (found[i][0] + n, [*found[i][1], shard])
        first += slots[s]
    return [(n, len(shards), min(shards, default=None), max(shards, default=None)) for n, shards in found.values()]


def test_equal_to_the_plain_version(documents):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(corpus())] + [(i, " ".join(f"h{i}_{j}" for j in range(i % 90)), "hot") for i in range(200, 900)]
    mix = Mix(block=16, shard_slots=8)
    clashing = documents(rows).withColumns({c: F.lit(1) for c in ("size", "start", "bucket", "block", "group", "shard", "tie", "source_key")})
    out = {r.doc_id: (r.taken, r.pieces, r.first_shard, r.last_shard) for r in mix_counts(clashing, mix).collect()}
    assert [out[i] for i, _, _ in rows] == plain_mix(rows, mix)
    long = [(0, "word " * 300_000, "a"), (1, "b c", "b")]
    assert {r.doc_id: (r.size, r.taken) for r in mix_counts(documents(long)).collect()} == {0: (300_000, 450_003 - 4), 1: (2, 4)}


def corpus():
    rows = []
    for i in range(120):
        source = [None, "b", "a", "ü", "z"][min(i % 7, 4)]
        text = None if i == 5 else "" if i == 6 else " ".join(f"w{i}_{j}" for j in range(3000 if i == 9 else i % 40))
        rows.append((i, text, source))
    return [*rows, rows[20], rows[20]]


def test_targets_taken_and_limits(documents):
    rows = corpus()
    mix = Mix(block=16, shard_slots=8)
    out = mix_counts(documents(rows), mix).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = plain_targets(sizes)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mix_counts(documents(rows[::-1]), mix).collect()), key=str)


def test_documents_hold_the_words_taken(documents):
    rows = [r for r in corpus()[:120] if r[0] != 20]
    mix = Mix(block=16, shard_slots=8)
    counts = {r.doc_id: r.taken for r in mix_counts(documents(rows), mix).collect()}
    mixed = in_shards(mix_documents(documents(rows), mix)).withColumn("part", F.spark_partition_id())
    assert mixed.groupBy("shard").agg(F.countDistinct("part").alias("n")).filter("n > 1").isEmpty()
    words = collections.Counter()
    allowed = {i: set((t or "").split()) for i, t, _ in rows}
    for r in mix_documents(documents(rows), mix).collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= allowed[r.doc_id] and r.n_chars == len(r.text)
    assert all(words[i] == n for i, n in counts.items())


def test_no_words_and_no_rows(documents):
    out = mix_counts(documents([None, "", " \n"])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3
    assert mix_counts(documents(["a"]).limit(0)).count() == 0
    assert mix_documents(documents(["a"]).limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 10, 37):
        out = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))
    many = [r.p for r in spark.range(1000).select(permuted(F.col("id"), F.lit(1000).cast("long"), F.lit(7).cast("long")).alias("p")).collect()]
    assert sum(a + 1 == b for a, b in zip(many, many[1:])) < 10


def test_shards_are_full_and_drawn_from_all_sources(documents):
    mix = Mix(block=4, shard_slots=32)
    targets = source_targets(sized(documents(corpus())), mix)
    counts = shard_counts(slots(targets, mix)).collect()
    by_shard = collections.Counter()
    for r in counts:
        by_shard[r.shard] += r.slots
    assert all(n == 32 for s, n in by_shard.items() if s != max(by_shard))

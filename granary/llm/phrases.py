"""Phrases whose words belong together, by language, counted in stripes.

A stripe is what follows a prefix: an associative array from next word to number. Tasks build the stripes of their texts,
stripes of one prefix meet in a shuffle and are merged element by element. From merged stripes come the phrases (prefix
and next word), what a phrase's parts occur (the stripes one word shorter) and how often a phrase's most frequent extension
by a word occurs: to its right in its own stripe, to its left in the stripes that drop its first word.

A phrase can't be more frequent than its parts, so each pass over the texts adds a word: the stripe of the empty prefix (words),
then stripes of one, two and three words, built only where both parts of a phrase, one word shorter, are frequent. What is
frequent is sent as a filter of a fixed 2^26 bits: it lets all frequent ones through and a few others, which their counts
remove. As a longer candidate has a candidate one word longer inside it that is as frequent, one-word extensions decide which
phrases go.

The stripe of the empty prefix is dealt out by word. The stripes of frequent prefixes, of which there are at most 65,536
(`most_hot`), are dealt out in segments of about as many occurrences as the rarest of those has.

Words are told apart by hashes of 64 bits; should two words of a language share one, all is counted anew with other hashes.
A null lang is `und`, and one with a lang of that name. Null and empty texts have no words. Long texts are worked on in
stretches cut between pieces. Repeated rows count as often as they occur. Ties go to the phrase that comes first in UTF-8.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, stored, table
from granary.llm.shingles import mixed

MOST_WORDS = 4
LEAST = 30
#: A phrase goes if a longer one has this part of its occurrences, in per cent.
WITHIN = 80
FIRST = 2000
UNIT = 2_000_000
LEAST_SHARD_BITS, MOST_SHARD_BITS = 10, 20
#: Occurrences for each place where stripes meet, beyond the least number of places.
OF_A_SHARD = 1 << 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What ends a piece, and what else separates words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def byte_values(seed: int) -> np.ndarray:
    """A random value for each byte, the same for A-Z and a-z, 0 for what separates words."""
    values = np.random.default_rng(abs(seed) * 2 + (seed < 0)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[list(ENDS + BLANKS)] = 0
    return values


@dataclass(frozen=True)
class Counting:
    """How stripes are counted; no result depends on it. Bytes of text worked on at once, words whose stripes are built at once, bits of
    a filter, how many prefixes may be frequent and how many occurrences such a one has at least, random values for bytes by seed."""

    stretch: int = 1 << 20
    together: int = 1 << 20
    filter_bits: int = 26
    most_hot: int = 1 << 16
    least_hot: int = 1 << 16
    values: Callable[[int], np.ndarray] = byte_values


def _words(data: np.ndarray, values: np.ndarray, heads: np.ndarray) -> Words:
    """Hash, begin, end and piece (a growing number) of each word; heads: where texts begin."""
    solid = values[data] != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    ends = ~solid
    ends[heads[heads > 0]] = True
    # The first position after each begin that holds no word, or another text's begin.
    stops = np.append(np.flatnonzero(ends), len(data))
    ends_at = stops[np.searchsorted(stops, starts, side="right")]
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.full(int((ends_at - starts).max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = np.where(solid, values[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    is_end = np.isin(data, np.frombuffer(ENDS, np.uint8))
    pieces = np.cumsum(is_end)[starts] + np.searchsorted(heads, starts, side="right")
    return mixed(np.add.reduceat(terms, starts)), starts, ends_at, pieces


def _stretches(batch: pa.RecordBatch, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, begins of texts and rows of those texts, cut between texts or pieces; a longer piece is taken whole."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = int(offsets[0])
    while at < offsets[-1]:
        last = int(offsets[np.searchsorted(offsets, at + stretch, side="right") - 1])
        if last <= at:  # one text is longer
            row = int(np.searchsorted(offsets, at, side="right"))
            cuts = np.flatnonzero(np.isin(data[at : offsets[row]], np.frombuffer(ENDS, np.uint8))) + 1
            fit = np.searchsorted(cuts, stretch, side="right")
            last = at + int(cuts[max(fit - 1, 0)]) if len(cuts) else int(offsets[row])
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        rows = np.arange(first, int(np.searchsorted(offsets, last, side="left")))
        rows = rows[np.diff(offsets)[rows] > 0]
        yield data[at:last], np.maximum(offsets[rows] - at, 0), rows
        at = last


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _language_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 1)


def _bits(bits: int, *keys: np.ndarray) -> np.ndarray:
    """Where a language and words stand in a filter of so many bits (a power of two)."""
    x = keys[0].astype(np.uint64)
    for k in keys[1:]:
        x = mixed(x * _STEP + k.astype(np.uint64))
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text <> ''")


def vocabulary(docs: DataFrame, seed: int, how: Counting = Counting()) -> DataFrame:
    """The merged stripe of the empty prefix: lang, next (hash), f, word, and another word of that hash if there is one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, others = how.values(seed), byte_values(-1 - seed)
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        for batch in batches:
            langs, codes = _languages(batch)
            for data, heads, rows in _stretches(batch, how.stretch):
                hashes, starts, ends, _ = _words(data, values, heads)
                owner = codes[rows[np.searchsorted(heads, starts, side="right") - 1]] if len(starts) else starts
                # Words of one hash differ in this one, so that each of them is sent.
                second = _words(data, others, heads)[0]
                order = np.lexsort((second, hashes, owner))
                new = np.flatnonzero(np.append(True, np.any([np.diff(x[order]) != 0 for x in (second, hashes, owner)], axis=0))) if len(order) else order
                counts = np.diff(np.append(new, len(order)))
                first = order[new]
                raw = data.tobytes().translate(lower)
                words = [raw[b:e] for b, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                lang = pa.array(langs, pa.string()).take(pa.array(owner[first]))
                columns = [lang, pa.array(hashes[first].view(np.int64)), pa.array(counts), pa.array(words, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "next", "f", "word"])

    parts = _texts(docs).mapInArrow(counted, "lang string, next long, f long, word string")
    return parts.groupBy("lang", "next").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))


def _filter(how: Counting, frequent: DataFrame, *words: str):
    """A broadcast filter of the languages and words in rows of `frequent`."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes = _languages(batch)
            of = np.array([_language_hash(x) for x in langs], np.uint64)
            at = _bits(how.filter_bits, of[codes], *(batch.column(w).to_numpy() for w in words))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["slot", "bits"])

    slots = frequent.select("lang", *words).mapInArrow(marked, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << how.filter_bits - 5, np.uint32)  # as many rows at most come to the driver
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out)


def _inside(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _hot(how: Counting, frequent: DataFrame, occurrences: int, *words: str):
    """Broadcast: positions in a filter of the prefixes that hold much, and into how many segments their stripes go."""
    share = max(how.least_hot, occurrences // how.most_hot)
    rows = frequent.filter(F.col("f") >= share).select("lang", *words, "f").toArrow()  # at most most_hot, as their occurrences add up to no more than all
    of = np.array([_language_hash(x) for x in rows.column("lang").to_pylist()], np.uint64)
    at = _bits(how.filter_bits, of, *(rows.column(w).to_numpy() for w in words)) if len(of) else np.zeros(0, np.int64)
    segments = rows.column("f").to_numpy() // share + 1
    order = np.argsort(at, kind="stable")
    return frequent.sparkSession.sparkContext.broadcast((at[order], segments[order]))


def _segment(hot: tuple[np.ndarray, np.ndarray], prefix: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The segment of a stripe that the next word is in."""
    places, segments = hot
    if not len(places):
        return np.zeros(len(prefix), np.int64)
    at = np.minimum(np.searchsorted(places, prefix), len(places) - 1)
    many = np.where(places[at] == prefix, segments[at], 1)
    return ((following >> np.uint64(8)) % many.astype(np.uint64)).astype(np.int64)


def bundles(langs: list[str], lang: np.ndarray, prefix: list[np.ndarray], segment: np.ndarray, following: np.ndarray, shard_bits: int) -> pa.RecordBatch:
    """The stripes of occurrences, those that meet in one place as a row: lang, shard, and by entry the prefix (w1 and so on), the next word and their number.

    A prefix's hash, in segments if it is frequent, says where its stripes meet."""
    place = mixed(segment.astype(np.uint64) + _STEP)
    for w in prefix:
        place = mixed(place * _STEP + w)
    order = np.lexsort((following, place, lang))
    shard = (place[order] >> np.uint64(64 - shard_bits)).astype(np.int64)
    lang, following, prefix = lang[order], following[order], [w[order] for w in prefix]
    row = np.append(True, (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1]))
    entry = row.copy()
    entry[1:] |= np.any([x[1:] != x[:-1] for x in (*prefix, following)], axis=0)
    entries, heads = np.flatnonzero(entry), np.flatnonzero(row)
    offsets = pa.array(np.append(np.searchsorted(entries, heads), len(entries)).astype(np.int32))
    counts = np.diff(np.append(entries, len(order)))
    columns = [pa.array(langs, pa.string()).take(pa.array(lang[heads])), pa.array(shard[heads])]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(x[entries].view(np.int64))) for x in (*prefix, following)]
    columns.append(pa.ListArray.from_arrays(offsets, pa.array(counts)))
    return pa.RecordBatch.from_arrays(columns, ["lang", "shard", *(f"w{i + 1}" for i in range(len(prefix))), "next", "n"])


Chosen = tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]


def _extensions(size: int, bits: int, h: np.ndarray, of: np.ndarray, same: np.ndarray, marks: np.ndarray, hot) -> Chosen:
    """Occurrences of phrases of `size` words whose first and last size - 1 words are frequent: prefix, where they begin, the next word and its segment."""
    m = len(h) - size + 2
    places = _bits(bits, of[:m], *(h[i : i + m] for i in range(size - 1)))
    known = _inside(marks, places)
    for i in range(size - 2):
        known &= same[i : i + m]
    at = np.flatnonzero(known[:-1] & known[1:] & same[: m - 1])
    following = h[at + size - 1]
    return [h[at + i] for i in range(size - 1)], at, following, _segment(hot, places[at], following)


def _striped(docs: DataFrame, seed: int, how: Counting, size: int, occurrences: int, marks, hot) -> DataFrame:
    """Frequent phrases of `size` words, counted: stripes of each task, merged element by element where those of a prefix meet. Places
    are as many as keep what is merged at once to a few million occurrences."""
    shard_bits = min(max((occurrences // OF_A_SHARD).bit_length(), LEAST_SHARD_BITS), MOST_SHARD_BITS)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, filled, segments = how.values(seed), marks.value, hot.value
        names: dict[str, int] = {}
        kept: list[tuple] = []
        gathered = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if gathered:
                lang, following, segment = (np.concatenate([p[i] for p in kept]) for i in (0, 2, 3))
                prefix = [np.concatenate(x) for x in zip(*(p[1] for p in kept), strict=True)]
                yield bundles(list(names), lang, prefix, segment, following, shard_bits)
            kept.clear()

        for batch in batches:
            langs, codes = _languages(batch)
            own = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[codes]
            hashes_of = np.array([_language_hash(x) for x in names], np.uint64)
            for data, heads, rows in _stretches(batch, how.stretch):
                h, starts, _, pieces = _words(data, values, heads)
                if len(h) < MOST_WORDS:  # so that slices of all lengths exist
                    h, pieces = np.append(h, np.zeros(MOST_WORDS, np.uint64)), np.append(pieces, -np.arange(1, MOST_WORDS + 1))
                    starts = np.append(starts, np.full(MOST_WORDS, len(data)))
                lang = own[rows[np.maximum(np.searchsorted(heads, starts, side="right") - 1, 0)]]
                prefix, at, following, segment = _extensions(size, how.filter_bits, h, hashes_of[lang], pieces[1:] == pieces[:-1], filled, segments)
                kept.append((lang[at], prefix, following, segment))
                gathered += len(at)
                if gathered >= how.together:
                    yield from flushed()
                    gathered = 0
        yield from flushed()

    prefix = [f"w{i}" for i in range(1, size)]
    arrays = ", ".join(f"{c} array<long>" for c in (*prefix, "next", "n"))
    met = _texts(docs).mapInArrow(built, f"lang string, shard long, {arrays}").repartition("shard").sortWithinPartitions("shard")
    columns = (*prefix, "next")
    return met.mapInArrow(lambda batches: _merged(batches, columns), f"lang string, {', '.join(f'{c} long' for c in columns)}, f long")


def _merged(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Bundles in order of their place, those of one place merged element by element; what is frequent stays. One place is held at a time."""
    here, parts = None, []

    def merged() -> pa.RecordBatch:
        lang, *keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((*keys[::-1], lang))
        keys = [x[order] for x in (lang, *keys)]
        heads = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0)))
        totals = np.add.reduceat(counts[order], heads)
        heads, totals = heads[totals >= LEAST], totals[totals >= LEAST]
        langs = pa.array(list(names), pa.string()).take(pa.array(keys[0][heads]))
        return pa.RecordBatch.from_arrays([langs, *(pa.array(x[heads]) for x in keys[1:]), pa.array(totals)], ["lang", *columns, "f"])

    names: dict[str, int] = {}
    for batch in batches:
        langs, codes = _languages(batch)
        own = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[codes]
        shards = batch.column("shard").to_numpy()
        heads = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else shards
        for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), len(shards)], strict=True):
            if parts and here != shards[begin]:
                yield merged()
                parts = []
            here, some = shards[begin], batch.slice(begin, end - begin)
            sizes = some.column("n").value_lengths().to_numpy()
            parts.append((np.repeat(own[begin:end], sizes), *(some.column(c).flatten().to_numpy() for c in (*columns, "n"))))
    if parts:
        yield merged()


def phrases(docs: DataFrame, how: Counting = Counting()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: words (lang, next, word) that are frequent, totals (lang, n), and all frequent phrases of 1 to 4 words (lang, phrase: hashes, f)."""
    seed = 0
    while True:
        words = stored(vocabulary(docs, seed, how), "words")
        if words.filter("word <> other").isEmpty():
            break
        discard(words)
        seed += 1
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    frequent = stored(words.filter(F.col("f") >= LEAST).select("lang", "next", "word", "f"), "words-frequent")
    discard(words)
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    levels, columns = [frequent], ["next"]
    for size in range(2, MOST_WORDS + 1):
        longer = _striped(docs, seed, how, size, occurrences, _filter(how, levels[-1], *columns), _hot(how, levels[-1], occurrences, *columns))
        levels.append(stored(longer, f"stripes-{size - 1}"))
        columns = [*(f"w{i}" for i in range(1, size)), "next"]
    found = frequent.select("lang", F.array("next").alias("phrase"), "f")
    for level in levels[1:]:
        found = found.unionByName(level.select("lang", F.array(*level.columns[1:-1]).alias("phrase"), "f"))
    found = stored(found, "phrases")
    discard(*levels[1:])
    return frequent, totals, found


def collocations(docs: DataFrame, how: Counting = Counting()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first of each lang."""
    words, totals, found = phrases(docs, how)
    candidates = found.filter(F.size("phrase") > 1).withColumnRenamed("f", "a")
    n = F.size("phrase")
    inner = F.array(F.slice("phrase", F.lit(1), n - 1), F.slice("phrase", F.lit(2), n - 1))
    longest = candidates.filter(n > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").filter("most IS NULL OR 100 * most < a * " + str(WITHIN))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, n - F.col("k")).alias("right"))
    left, right = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr(f"CAST(a AS decimal(28, 0)) * {UNIT} div (CAST(l AS decimal(28, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = stored(scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest), "phrases-scored")
    spelt = scored.select("lang", "phrase", F.posexplode("phrase").alias("pos", "next")).join(words.select("lang", "next", "word"), ["lang", "next"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "word")))
    spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(parts, lambda x: x["word"]), " ").alias("spelling"))
    rows = scored.join(spelt, ["lang", "phrase"]).select("lang", F.col("spelling").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= FIRST)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
i AS (SELECT lang, array_to_string(w[b : b + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS b) WHERE k > m AND b + m - 1 <= k GROUP BY ALL),
q AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * c.a),
s AS (SELECT q.lang, q.phrase, q.a, j, l.f AS l, r.f AS r, ((2000000 * q.a::HUGEINT) // (l.f + r.f))::BIGINT AS score FROM q, (SELECT unnest([1, 2, 3]) AS j), g l, g r
  WHERE j < q.k AND l.lang = q.lang AND l.phrase = array_to_string(q.w[1:j], ' ') AND r.lang = q.lang AND r.phrase = array_to_string(q.w[j + 1 :], ' ')),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM u JOIN t USING (lang) QUALIFY rank <= 2000
"""

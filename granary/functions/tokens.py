"""Token counts by a byte-pair vocabulary: a table of pieces with their merge ranks, applied to words.

A text is cut into words by the vocabulary's pattern, a word into bytes, and the neighbours whose joined piece has the lowest
rank are merged until none is known. The vocabulary goes to all tasks, after a count; counts of short words are kept there.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: What cuts a text into words: endings, letters, digits and marks with the blank before them, runs of blanks.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Largest vocabulary that is sent to tasks, and what they keep of words.
MOST_PIECES = 2_000_000
MOST_KEPT, KEPT_BYTES = 200_000, 48


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """piece (binary) and rank of a vocabulary file: a piece in base 64 and its rank a line."""
    lines = F.split("value", " ")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.unbase64(lines[0]).alias("piece"), lines[1].cast("int").alias("rank"))


def merged_count(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many pieces are left of a word. Pieces form a chain; a heap holds the joints that may be merged, least rank first,
    the leftmost of equals; joints whose pieces have changed since are passed over."""
    if word in ranks:
        return 1
    ends, before, after = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    alive = [True] * len(word)

    def joint(at: int) -> None:
        following = after[at]
        if following < len(word) and (rank := ranks.get(word[at : ends[following]])) is not None:
            heapq.heappush(heap, (rank, at, ends[following]))

    heap: list[tuple[int, int, int]] = []
    for i in range(len(word) - 1):
        joint(i)
    n = len(word)
    while heap:
        _, at, end = heapq.heappop(heap)
        following = after[at] if alive[at] else len(word)
        if following >= len(word) or ends[following] != end:
            continue
        alive[following], ends[at], after[at] = False, end, after[following]
        if after[at] < len(word):
            before[after[at]] = at
        n -= 1
        joint(at)
        if before[at] >= 0:
            joint(before[at])
    return n


@dataclass
class Vocabulary:
    """Ranks by piece and the pattern of words; counts tokens of texts."""

    ranks: dict[bytes, int]
    words: str = WORDS
    kept: dict[bytes, int] = field(default_factory=dict, repr=False)
    _pattern: object = field(default=None, repr=False)

    def count(self, text: str | None) -> int:
        if self._pattern is None:
            self._pattern = regex.compile(self.words)
        return sum(self._word(w.encode("utf-8", "surrogatepass")) for w in self._pattern.findall(text or ""))

    def _word(self, word: bytes) -> int:
        n = self.kept.get(word)
        if n is None:
            n = merged_count(word, self.ranks)
            if len(word) <= KEPT_BYTES:
                if len(self.kept) >= MOST_KEPT:
                    self.kept.clear()
                self.kept[word] = n
        return n


class TokenCounter:
    """Counts tokens in columns by a vocabulary (piece, rank)."""

    def __init__(self, vocabulary: DataFrame, words: str = WORDS):
        rows = vocabulary.select("piece", "rank").limit(MOST_PIECES + 1).collect()
        if len(rows) > MOST_PIECES:
            raise ValueError(f"a vocabulary may have {MOST_PIECES} pieces")
        shared = vocabulary.sparkSession.sparkContext.broadcast({bytes(r.piece): r.rank for r in rows})
        made: list[Vocabulary] = []  # one a worker process

        def counter() -> Vocabulary:
            if not made:
                made.append(Vocabulary(shared.value, words))
            return made[0]

        @pandas_udf(T.LongType())
        def one(texts: pd.Series) -> pd.Series:
            return texts.map(counter().count).astype("int64")

        @pandas_udf(T.ArrayType(T.LongType()))
        def each(pieces: pd.Series) -> pd.Series:
            return pieces.map(lambda some: [counter().count(p) for p in some] if some is not None else [])

        self._one, self._each = one, each

    def count(self, c: Column | str) -> Column:
        """Tokens of a text; none of a null."""
        return self._one(F.col(c) if isinstance(c, str) else c)

    def sized(self, pieces: Column) -> Column:
        """Pieces with their tokens, as `packed_sized` takes them."""
        return F.transform(F.arrays_zip(pieces.alias("p"), self._each(pieces).alias("n")), lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n")))


def to_lines(ranks: Iterable[tuple[bytes, int]]) -> str:
    """The text of a vocabulary file."""
    return "".join(f"{base64.b64encode(piece).decode()} {rank}\n" for piece, rank in ranks)

"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The encoding of a string by byte-pair merges is the one sequence of pieces in which every neighbouring pair, encoded on
its own, stays the same pair. So the last piece of a prefix is the one piece that ends there and stands well with the
last piece of the prefix before it, and the count at each prefix is the count before that piece plus one. A table of
counts at all prefixes answers how many tokens any prefix has and where a budget cuts a text, without encoding again.

No piece of the model crosses from a word into the blank after it, and a character outside the model never merges, so
the table of a text is put together from its words', which are kept from text to text (a bounded number of them).

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows come back as often as they came; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import table, text_or_empty

BLANK = "▁"
#: Words, and pairs of pieces, that a worker keeps; longer words aren't kept (but for a note of so many bytes of them).
WORDS_KEPT, LONGEST_KEPT, LONG_BYTES = 700_000, 64, 4 << 20
LIMIT = 4096
MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Counts for one merge model with byte fallback, blanks kept and a blank put before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(m.vocab_size()) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)]
        self._score = {m.id_to_piece(i): m.get_score(i) for i in set(range(m.vocab_size())) - set(special)}
        runs = {p for p in self._score if p.strip(BLANK) == "" and len(p) > 1}
        if any(BLANK in p[1:] for p in self._score if p not in runs):
            raise ValueError("pieces of this model go past a blank")
        if runs and max(self._score[p] for p in runs) >= min(s for p, s in self._score.items() if len(p) > 1 and p not in runs):
            raise ValueError("runs of blanks must merge last")
        self._pieces = list(self._score)
        self._blank = self._pieces.index(BLANK)
        self._endings: dict = {}  # a tree over the pieces read backwards; "" holds the piece's number
        for number, piece in enumerate(self._pieces):
            node = self._endings
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[""] = number
        self._pairs: dict[int, bool] = {}
        self._run_lengths: dict[int, int] = {0: 0, 1: 1}
        self._words = _Words(self)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short string without runs of blanks: the best-scored neighbours merge first, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self._score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, left: int, piece: int) -> bool:
        """Whether a piece may follow another one, or (-1) begin; kept in _pairs under left * number of pieces + piece."""
        text = self._pieces[piece]
        if left < 0:
            ok = self._merged(text) == [text]
        else:
            before = self._pieces[left]
            ok = self._merged(before + text) == [before, text]
        self._pairs[left * len(self._pieces) + piece] = ok
        return ok

    def _run(self, blanks: int) -> int:
        """Tokens of a run of blanks alone."""
        if blanks not in self._run_lengths:
            self._run_lengths[blanks] = len(self._model.encode(" " * (blanks - 1)))
        return self._run_lengths[blanks]

    def table_of(self, text: str) -> tuple[list[int], list[bool]]:
        """For prefixes 0 .. len(text) of a string without runs of blanks: the count, and whether the first piece is a lone blank."""
        pairs, n_pieces = self._pairs, len(self._pieces)
        counts, last, lone = [0], [-1], [False]
        for i in range(len(text)):
            node, j = self._endings, i
            while j >= 0:
                node = node.get(text[j])
                if node is None:
                    j = -1
                    break
                piece = node.get("")
                if piece is not None:
                    ok = pairs.get(last[j] * n_pieces + piece)
                    if ok or (ok is None and self._stands(last[j], piece)):
                        break
                j -= 1
            if j >= 0:
                counts.append(counts[j] + 1)
                last.append(piece)
                lone.append(lone[j] if j else piece == self._blank)
            else:  # a character outside the model: its bytes, which never merge
                counts.append(counts[i] + len(text[i].encode()))
                last.append(-1)
                lone.append(lone[i])
        return counts, lone

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        parts = text.replace(BLANK, " ").split(" ")
        words = self._words
        if "" not in parts:
            total = sum(map(words.__getitem__, parts))
        else:
            total, run = 0, 0
            for part in parts:
                run += 1
                if part:
                    n = words[part]
                    total += self._with_run(run, n, part in words.lone)
                    run = 0
            total += self._run(run)
        if len(words) > WORDS_KEPT or words.long > LONG_BYTES:
            words.clear()
            words.lone.clear()
            words.long = 0
        if len(self._pairs) > WORDS_KEPT:
            self._pairs.clear()
        return total

    def _with_run(self, run: int, n: int, lone: bool) -> int:
        """Tokens of a run of blanks and the word after it, from the word's with one blank."""
        if run == 1:
            return n
        return self._run(run) + n - 1 if lone else self._run(run - 1) + n

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k = 0 .. len(text); each is what encoding that prefix by itself gives."""
        out, total, run = [0], 0, 0
        for i, part in enumerate(text.replace(BLANK, " ").split(" ")):
            run += 1
            if i:
                out.append(total + self._run(run))
            if part:
                counts, lone = self.table_of(BLANK + part)
                out.extend(total + self._with_run(run, n, one) for n, one in zip(counts[2:], lone[2:], strict=True))
                total, run = out[-1], 0
        return np.array(out, dtype=np.int64)


    def longest_prefix(self, text: str, n: int, budget: int) -> int:
        """Characters of the longest prefix whose own encoding has at most budget tokens, of a text with n tokens.

        Words are passed by their counts, which never fall at the ends of words, up to the first that goes beyond the
        budget; only its table is looked into."""
        if n <= budget:
            return len(text)
        best = at = total = run = 0
        for i, part in enumerate(text.replace(BLANK, " ").split(" ")):
            run += 1
            if i:
                at += 1
                best = at if total + self._run(run) <= budget else best
            if not part:
                continue
            count = self._words[part]
            end = total + self._with_run(run, count, part in self._words.lone)
            if end > budget:
                counts, lone = self.table_of(BLANK + part)
                within = [k for k, (c, one) in enumerate(zip(counts[2:], lone[2:], strict=True), 1) if total + self._with_run(run, c, one) <= budget]
                return at + within[-1] if within else best
            total, run, at = end, 0, at + len(part)
            best = at
        return best


class _Words(dict):
    """For each word seen, its count with the blank before it; lone: the words whose blank is a piece of its own."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self._counter = counter
        self.lone: set[str] = set()
        self.long = 0

    def __missing__(self, word: str) -> int:
        counts, lone = self._counter.table_of(BLANK + word)
        if lone[-1]:
            self.lone.add(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = counts[-1]
        else:
            self.long += len(word)
        return counts[-1]


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter, with the words that it keeps, for each Python worker."""
    return PrefixCounter(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit, fitting_chars: characters of the longest prefix within the limit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(tokenizer_path(model))
        for batch in batches:
            texts = _texts(batch)
            n = [tables.count(t) for t in texts]
            fitting = pa.array(map(tables.longest_prefix, texts, n, itertools.repeat(limit)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), fitting], ["doc_id", "n_bytes", "n_tokens", "fitting_chars"])

    rows = docs.select("doc_id", "text", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, fitting_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")


def prefix_tables(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, tokens_at: the token count of the first k characters, for k = 0 .. the text's length."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(tokenizer_path(model)).prefixes
        for batch in batches:
            at = pa.array([prefixes(t).tolist() for t in _texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), at], ["doc_id", "tokens_at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tables, f"doc_id {kind}, tokens_at array<int>")


def characters_within(budget: Column | int, tokens_at: str = "tokens_at") -> Column:
    """The longest prefix, in characters, whose own encoding has at most budget tokens; from a stored table."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_max(F.transform(tokens_at, lambda n, k: F.when(n <= budget, k)))


def tokens_of_prefix(characters: Column | int, tokens_at: str = "tokens_at") -> Column:
    """Tokens of the first so many characters (of the whole text, if it has fewer)."""
    characters = characters if isinstance(characters, Column) else F.lit(characters)
    return F.element_at(tokens_at, F.least(characters + 1, F.size(tokens_at)).cast("int"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

import random

import pytest
import sentencepiece
from granary.llm.token_counts import MODEL, PrefixCounter, characters_within, count_tokens, prefix_tables, tokenizer_path, tokens_of_prefix
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

COUNTER = PrefixCounter(tokenizer_path(MODEL))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list(" abcdeinrtTHE.,\n\té日本▁0123ßüñ😀") + ["the ", "ing", "  ", "</s>", "<unk>"]), max_size=60).map("".join))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list(" abtheing.\né日▁😀")), max_size=30).map("".join))
def test_every_prefix_equals_its_own_encoding(text):
    assert COUNTER.prefixes(text).tolist() == [len(LIBRARY.encode(text[:k])) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", [" " * 40, "a" * 5000, "x " * 3000, "\n" * 100, "▁▁ ▁"])
def test_runs_and_long_texts(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_rows(documents):
    texts = [None, "", "the cat sat", "the cat sat", "word " * 5000]
    rows = {r.doc_id: r for r in count_tokens(documents(texts)).collect()}
    assert [rows[i].n_tokens for i in range(5)] == [len(LIBRARY.encode(t or "")) for t in texts]
    assert [rows[i].n_bytes for i in range(5)] == [len((t or "").encode()) for t in texts]
    assert [rows[i].over_limit for i in range(5)] == [False] * 4 + [True]
    assert [rows[i].fitting_chars for i in range(4)] == [0, 0, 11, 11]
    assert count_tokens(documents(texts).limit(0)).count() == 0
    clashing = documents(texts).withColumnsRenamed({"n_chars": "n_bytes", "lang": "n_tokens", "source": "fitting_chars"})
    assert sorted(map(str, count_tokens(clashing).collect())) == sorted(map(str, rows.values()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list(" abtheing.\né日▁😀") + ["  ", "the "]), max_size=60).map("".join), st.integers(1, 12))
def test_the_longest_prefix_within_a_budget(text, budget):
    fitting = [k for k in range(len(text) + 1) if len(LIBRARY.encode(text[:k])) <= budget]
    assert COUNTER.longest_prefix(text, COUNTER.count(text), budget) == max(fitting)


def test_budgets_are_answered_from_the_table(documents):
    random.seed(1)
    texts = [None, "the thing   is\nin the ring", "".join(random.choice("thein g") for _ in range(80))]
    tables = prefix_tables(documents(texts))
    for r in tables.select("doc_id", characters_within(7).alias("k"), tokens_of_prefix(9).alias("n")).collect():
        text = texts[r.doc_id] or ""
        fitting = [k for k in range(len(text) + 1) if len(LIBRARY.encode(text[:k])) <= 7]
        assert r.k == max(fitting) and r.n == len(LIBRARY.encode(text[:9]))
    assert tables.filter(F.size("tokens_at") == 1).count() == 1

"""Counts at prefixes against the library that owns the model."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from inversia.llm import tokens
from tests.llm.messy import documents, empty, messy

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
COUNTER = tokens.counter(None)
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t▁abcdetho<s>/éß中🙂."), st.characters(exclude_categories=("Cs",), exclude_characters="\0")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_any_text(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_every_prefix(text):
    assert COUNTER.prefix_counts(text) == [len(MODEL.encode(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " \n ", "▁", "a  b   c", "<s> </s> <unk> <0x0A>", "x" * 3000, "the " * 2000, "\ta\r\n"])
def test_edges(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))
    assert COUNTER.prefix_counts(text[:50]) == [len(MODEL.encode(text[:i])) for i in range(len(text[:50]) + 1)]


def test_fits_is_the_longest_prefix_within_budget():
    text = "The cat sat on the mat, and the dog slept in the house by the river."
    counts = COUNTER.prefix_counts(text)
    for budget in range(counts[-1] + 2):
        n = COUNTER.fits(text, budget)
        assert max(counts[: n + 1]) <= budget and (n == len(text) or counts[n + 1] > budget)


@pytest.mark.parametrize("make", [messy, documents])
def test_table(spark, make):
    df = make(spark)
    got = sorted(map(tuple, tokens.count_tokens(df).collect()), key=repr)
    rows = df.select("doc_id", "text").collect()
    texts = [r.text or "" for r in rows]
    want = [(r.doc_id, len(t.encode()), n := len(MODEL.encode(t)), n > 4096) for r, t in zip(rows, texts)]
    assert got == sorted(want, key=repr)


def test_truncate(spark):
    for r in tokens.truncate(messy(spark), 10).collect():
        assert r.text is None or len(MODEL.encode(r.text)) <= 10


def test_empty_table(spark):
    assert tokens.count_tokens(empty(spark)).collect() == []

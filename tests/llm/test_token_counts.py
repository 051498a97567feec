import random

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evalspark.llm import token_counts
from llm.samples import CLASHES, documents, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = token_counts.PrefixCounter(PATH)


def by_library(text):
    return len(COUNTER.library.encode(text, add_special_tokens=False).ids)


def every_prefix(text):
    return [by_library(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "hello  world",
        "a  \n b\n\n\nc",
        "don't 've we'll 're'll x're 'S it's",
        " <|endoftext|> x<|endoftext|>",
        "abc  <|endoftext|>  def<|endof",
        "<|endoftext|><|endoftext|>",
        "tab\t\tx  y 　z",
        "日本語のテキスト \U0001f389\U0001f389 émile ﬁ",
        "a\x1cb \x1d c\x85d ﻿x ​",
        "²³¼ 12½ ªº ×÷ naïve",
        "   ",
        "x" * 150,
        "ab" * 60 + "é" * 40,
    ],
)
def test_prefixes(text):
    assert COUNTER.prefix_counts(text).tolist() == every_prefix(text)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sampled_from([*"ab'srevld \n\t!1é日 .<|>", "<|endoftext|>", "the ", "'ll"]), max_size=30).map("".join))
def test_random_texts(text):
    assert COUNTER.prefix_counts(text).tolist() == every_prefix(text)


def test_small_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    rng = random.Random(1)
    text = " ".join(rng.choice(["then", "thence", "other", "words", "wordy"]) for _ in range(200))
    assert COUNTER.prefix_counts(text)[-1] == by_library(text)
    assert COUNTER.prefix_counts(text[:300])[-1] == by_library(text[:300])


def test_table_and_questions(spark):
    rows = edge_rows()
    counted = token_counts.count_tokens(documents(spark, rows, clashing=True), PATH)
    got = counted.collect()
    assert set(CLASHES) <= set(counted.columns) and len(counted.columns) == len(set(counted.columns))
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == by_library(text)
        if len(text) < 2_000:
            counts = every_prefix(text)
            assert token_counts.unpack_counts(r["prefix_counts"]).tolist() == counts
            assert token_counts.tokens_at(r["prefix_counts"], len(text) // 2) == counts[len(text) // 2]
            for budget in (0, 3, 50):
                fits = max(i for i, n in enumerate(counts) if n <= budget)
                assert token_counts.longest_within(r["prefix_counts"], budget) == fits
    for r in token_counts.truncated(counted, 20).collect():
        assert r["text"] is None or by_library(r["text"]) <= 20


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0


def test_new_words_are_encoded_together(monkeypatch):
    rng = random.Random(3)
    parts = [*"abrstev\'1!,é日ß\n\x00", "the", "there", "'ll", "<|endoftext|>", "\U0001f389", "  ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(30)] + ["", " ", "x" * 90 + " end"]
    monkeypatch.setattr(token_counts, "BATCH", 7)
    counter = token_counts.PrefixCounter(PATH)
    units = counter.prepare(texts)
    learned = dict(counter.pieces)
    assert all(learned[p] == every_prefix(p)[1:] for p in learned if p != "<|endoftext|>")
    for text, names in zip(texts, units):
        assert counter.prefix_counts(text).tolist() == every_prefix(text)
        assert counter.prefix_counts(text, names).tolist() == every_prefix(text)
    # nothing of these is left to the loop over bytes
    again = token_counts.PrefixCounter(PATH)
    monkeypatch.setattr(again, "_piece", None)
    plain = ["then thence", "naïve straße 日本 ok", ""]
    for text, names in zip(plain, again.prepare(plain)):
        assert again.prefix_counts(text, names).tolist() == every_prefix(text)
    assert again.prepare([]) == []

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from evalspark.llm import phrases, quotient_filter
from evalspark.llm.phrases import mine_phrases
from evalspark.llm.quotient_filter import Layout
from llm.samples import documents, edge_rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_count, max_words=5, top=2000, percent=100):
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    often = {k: a for k, a in counts.items() if a >= min_count}
    kept = []
    for (lang, words), a in often.items():
        if len(words) == 1:
            continue
        longer = (
            f for (other, w), f in often.items()
            if other == lang and len(w) > len(words)
            and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
        )
        if any(100 * f >= percent * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[lang, words[:k]], often[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        kept.append((lang, " ".join(words), a, left, right, total[lang], score))
    out = []
    for lang in total:
        own = sorted((k for k in kept if k[0] == lang), key=lambda k: (-k[6], -k[2], k[1].encode()))[:top]
        out += [(k[0], i + 1, *k[1:]) for i, k in enumerate(own)]
    return sorted(out)


def found(spark, rows, *args, **more):
    schema = "lang string, text string, word string, n string, id string"
    df = spark.createDataFrame([(*r, "own", "own", "own") for r in rows], schema)
    return sorted(tuple(r) for r in mine_phrases(df.repartition(3), *args, **more).collect())


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["A", "b", "ba", "É", "the", "of", "x\xa0y", "z\x00", "\U0001f389"]
    ends = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?", " ; "]
    texts = []
    for _ in range(size):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40)))
        texts.append((rng.choice(["en", "en", "de", None, "und"]), text))
    texts += [("en", "in the year of our lord " * 3), ("de", None), ("de", ""), (None, " . , "), ("fr", None)] * 12
    return texts


@pytest.mark.parametrize("min_count,max_words,top,percent", [(10, 5, 2000, 100), (3, 3, 7, 100), (6, 4, 50, 60), (1, 2, 9, 100)])
def test_against_brute_force(spark, min_count, max_words, top, percent):
    rows = corpus(min_count, 60)
    want = brute(rows, min_count, max_words, top, percent)
    assert found(spark, rows, min_count, max_words, top, percent) == want
    assert want


def test_many_filters_and_small_tables(spark, monkeypatch):
    for name, value in (
        ("FILTER_ENTRIES", 64), ("SHARD_WORDS", 100), ("OPEN_WORDS", 3), ("KNOWN_WORDS", 4), ("BUCKETS", 5), ("TEXT_BYTES", 90),
        ("MOST_BITMAP_BITS", 1 << 10), ("SEGMENT_BITS", 1 << 8),
    ):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(2, 80)
    assert found(spark, rows, 8) == brute(rows, 8)


def test_edges_and_empty(spark):
    rows = edge_rows()
    got = mine_phrases(documents(spark, rows, clashing=True), min_count=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(r[2], r[1]) for r in rows], 4)
    assert mine_phrases(documents(spark, [])).count() == 0
    assert found(spark, [("en", "one two"), (None, None)], 5) == []


def test_long_text(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["in", "the", "year"]) for _ in range(200_000))
    assert found(spark, [("en", text)], 100) == brute([("en", text)], 100)


@pytest.mark.parametrize("words,bits", [(1, 1), (2, 7), (2, 32), (3, 13), (5, 12), (5, 13), (5, 25), (4, 32), (5, 32), (2, 1)])
def test_filters_keep_every_entry(words, bits):
    rng = np.random.default_rng(words * 100 + bits)
    layout = Layout(words, bits, 5)
    columns = [rng.integers(0, 1 << bits, 5_000).astype(np.int64) for _ in range(words)]
    limbs = quotient_filter.pack(columns, layout)
    permuted = quotient_filter.permute(limbs, layout)
    assert np.array_equal(quotient_filter.restore(permuted, layout), limbs)
    for a, b in zip(quotient_filter.unpack(limbs, layout), columns):
        assert np.array_equal(a.astype(np.int64), b)
    counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], 5_000)
    sorted_limbs, sums = quotient_filter.merged(permuted, counts)
    want = Counter()
    for gram, n in zip(zip(*(c.tolist() for c in columns)), counts.tolist()):
        want[gram] += n
    got = {}
    for shard, raw in quotient_filter.split(sorted_limbs, sums, layout):
        entries, n = quotient_filter.decode(raw, shard, layout)
        back = quotient_filter.unpack(quotient_filter.restore(entries, layout), layout)
        got |= dict(zip(zip(*(c.tolist() for c in back)), n.tolist()))
    assert got == dict(want)


def test_filters_are_compact_and_even():
    layout = Layout(2, 24, 5)
    rng = np.random.default_rng(3)
    columns = [np.sort(rng.integers(0, 1000, 200_000)), rng.integers(0, 1 << 20, 200_000)]
    entries, counts = quotient_filter.merged(
        quotient_filter.permute(quotient_filter.pack(columns, layout), layout), np.ones(200_000, np.int64)
    )
    filters = quotient_filter.split(entries, counts, layout)
    assert len(filters) == 32
    sizes = [len(raw) for _, raw in filters]
    assert max(sizes) < 1.1 * min(sizes)
    assert sum(sizes) < 6 * entries.shape[1]  # 48 bits of ids and a counter

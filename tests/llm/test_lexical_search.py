import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import lexical_search
from evalspark.llm.lexical_search import build_signatures, search, terms_of
from llm.samples import documents, edge_rows, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(fold)


def brute(docs, items, top=10):
    lists = [(i, terms(t)) for i, t in docs]
    lists = [(i, ts, Counter(ts)) for i, ts in lists if ts]
    count, total = len(lists), sum(len(ts) for _, ts, _ in lists)
    df = Counter(t for _, _, c in lists for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, ts, c in lists:
            m = 100 - 90 + 90 * len(ts) * count // total
            score = 0
            for t in set(terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((score, doc_id))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item_id, r + 1, d, s) for r, (s, d) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def found(spark, rows, items, top=10, clashing=False):
    docs = documents(spark, rows, clashing)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = search(docs.repartition(3), build_signatures(docs.repartition(3)), queries, top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_terms():
    for text in ("A b-C_d 1.2é È x\x7fyİ", "", "  ", "\U0001f389ab@cd"):
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_edges(spark):
    rows = edge_rows()
    items = [(1, "alpha1 beta2 gamma3 one"), (2, None), (2, "One one WORDS"), (None, "é only 3 shared line"), (4, "..")]
    assert found(spark, rows, items, clashing=True) == brute([r[:2] for r in rows], items)


def test_many_blocks_and_copies(spark, monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([1, 3, 30, 400])) + " alpha1" * rng.randrange(70) for _ in range(300)]
    texts += [texts[0]] * 60 + [texts[5] + " tail"] * 30
    rows = [(i * 7 % 997, t, None, None, None) for i, t in enumerate(texts)]
    items = [(i, sentence(rng, 6)) for i in range(40)] + [(90, texts[0]), (91, texts[5])]
    want = brute([r[:2] for r in rows], items, 5)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical_search, "ITEMS_PER_BLOCK", 7)
    monkeypatch.setattr(lexical_search, "ITEM_CHUNK", 3)
    monkeypatch.setattr(lexical_search, "OPEN_BLOCKS", 2)
    assert found(spark, rows, items, 5) == want
    # signatures without any room only bound less tightly
    monkeypatch.setattr(lexical_search, "MOST_BITS", 64)
    assert found(spark, rows, items, 5) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "alpha")]) == []
    assert found(spark, [(1, "alpha", None, None, None)], []) == []
    assert found(spark, [(1, "", None, None, None), (2, None, None, None, None)], [(1, "alpha")]) == []


@pytest.mark.parametrize("most_bits", [64, 1 << 22])
def test_bounds_are_never_below_the_score(monkeypatch, most_bits):
    monkeypatch.setattr(lexical_search, "MOST_BITS", most_bits)
    rng = random.Random(8)
    texts = [(" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 90)))).encode() for _ in range(50)]
    held = lexical_search._Pending(4)
    for i, text in enumerate(texts):
        counts = Counter(terms_of(text))
        levels = np.minimum(np.log2(list(counts.values())).astype(np.int64) + 1, lexical_search.LEVELS)
        held.rows.append((i, counts.total(), b"", lexical_search._term_keys(list(counts)), levels))
    block = held.block()
    matrix = np.frombuffer(block["slices"], np.uint8).reshape(block["bits"], -1)
    lengths = np.array(block["lengths"])
    factors = np.array([lexical_search.length_factor(int(n), 50, int(lengths.sum())) for n in lengths])
    words = [bytes([c]) for c in b"abcdefghij"]
    bounds = lexical_search._bounds(matrix, lengths, factors, lexical_search._term_keys(words), np.ones(10, np.int64))
    false = 0
    for d, text in enumerate(texts):
        counts = Counter(terms_of(text))
        for w, word in enumerate(words):
            tf = counts[word]
            exact = 1_000_000_000 * tf // (1000 * tf + 8 * int(factors[d]))
            assert bounds[w, d] >= exact
            false += bounds[w, d] > 0 == tf
    # full signatures exclude nothing, sparse ones nearly all documents without the term
    assert false > 20 if most_bits == 64 else false < 10

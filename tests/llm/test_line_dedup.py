import hashlib
import random
from collections import Counter

import numpy as np

from evalspark.llm import line_dedup
from llm.samples import CLASHES, documents, edge_rows


def brute(rows, min_docs, min_chars):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    lines = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for i, ls in lines:
        kept = [x for x in ls if count[key(x)] < min_docs]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(
        ((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=repr
    )


def test_edges(spark):
    rows = edge_rows()
    for min_docs, min_chars in ((3, 1), (10, 1), (2, 5), (1, 1), (10**6, 1)):
        df = line_dedup.drop_common_lines(documents(spark, rows, clashing=True), min_docs, min_chars)
        assert found(df) == brute([r[:2] for r in rows], min_docs, min_chars)
    assert df.columns.count("n_lines") == 1
    assert [r[0] for r in df.select("body").distinct().collect()] == ["own body"]
    assert set(CLASHES) <= set(df.columns)


def test_empty_table(spark):
    assert line_dedup.drop_common_lines(documents(spark, [])).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 5_000):
        h1, h2 = (rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(2))
        counts = rng.integers(1, 1000, size)
        stored = line_dedup.build_shard(h1, h2, counts)
        shard = line_dedup.Shard(stored)
        assert len(stored["fingerprints"]) == 8 * size
        assert np.array_equal(shard.counts_of(h1, h2), counts)
        other = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
        assert not shard.counts_of(other, other).any()


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "OPEN_SHARDS", 2)
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line {rng.randrange(60)}" for _ in range(20)), None, None, None) for i in range(60)]
    df = line_dedup.drop_common_lines(documents(spark, rows), min_docs=18)
    assert found(df) == brute([r[:2] for r in rows], 18, 1)

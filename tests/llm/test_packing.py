import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from evalspark.llm import packing
from llm.samples import documents, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_fit(lengths, capacity):
    free, places = [], {}
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        fits = [(f, row) for row, f in enumerate(free) if f >= lengths[piece]]
        if not fits:
            free.append(capacity)
        row = min(fits)[1] if fits else len(free) - 1
        free[row] -= lengths[piece]
        places[piece] = row
    return free


def test_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (1, 2, 37, 128):
        lengths = [rng.randint(1, capacity) for _ in range(800)]
        places = packing.best_fit(lengths, capacity)
        used = {}
        for (row, start), length in zip(places, lengths):
            used.setdefault(row, []).append((start, start + length))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        # free lengths are those of the plain search, whichever row of equal length is taken
        assert sorted(capacity - s[-1][1] for s in used.values()) == sorted(brute_fit(lengths, capacity))


def test_round_trip(spark):
    rows = edge_rows()
    encoder = packing.load_encoder(PATH, public_tokenizers.PATTERN)
    segments, folder = packing.pack_documents(
        documents(spark, rows, clashing=True), PATH, public_tokenizers.PATTERN, row_tokens=64, group_tokens=5_000
    )
    read = packing.read_segments(segments, folder)
    assert all(r["one_reset"] for r in read.collect())
    texts = {}
    for r in read.withColumn("key", F.struct("doc_id", "n_tokens")).collect():
        texts.setdefault((r["doc_id"], r["n_tokens"]), {}).setdefault(r["part"], []).append(r)
    want = sorted((r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in rows if r[0] is not None)
    assert sorted(k for k in texts if k[0] is not None for _ in texts[k][0]) == want
    for (doc_id, n), parts in texts.items():
        ids = b"".join(parts[p][0]["ids"] for p in sorted(parts))
        tokens = np.frombuffer(ids, "<u2").tolist()
        assert len(tokens) == n and len(parts) == max(1, -(-n // 64))
        assert encoder.decode(tokens) in {r[1] or "" for r in rows if r[0] == doc_id}


def test_files(spark):
    rows = [(i, "word " * (i + 1), None, None, None) for i in range(50)]
    segments, folder = packing.pack_documents(
        documents(spark, rows).coalesce(1), PATH, public_tokenizers.PATTERN, row_tokens=32
    )
    (name,) = {r["file"] for r in segments.collect()}
    matrix, ends, bits = (packing._read(folder, f"{name}.{k}") for k in ("ids", "cu_seqlens", "resets"))
    resets = np.unpackbits(bits, axis=1)
    placed = sorted((r["row"], r["start"], r["length"]) for r in segments.collect())
    assert ends.tolist() == [0, *np.cumsum([length for _, _, length in placed])]
    assert sorted(zip(*np.nonzero(resets))) == [(r, s) for r, s, _ in placed]
    assert matrix.shape == (1 + placed[-1][0], 32)


def test_empty_table(spark):
    segments, folder = packing.pack_documents(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert packing.read_segments(segments, folder).count() == 0

import hashlib
import random

from pyspark.sql import functions as F

from evalspark.llm import fingerprints
from llm.samples import documents, edge_rows, sentence


def edited(rows):
    """The edited texts in the order of doc_id, null first, then of the text."""
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for n, (_, i, text) in enumerate(ordered):
        half = len(text) // 2
        out.append((text, text[: len(text) - half] + ordered[(n + 1) % len(ordered)][2][:half]))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edges(spark):
    rows = edge_rows()
    got = fingerprints.edited_fingerprints(documents(spark, rows, clashing=True)).collect()
    want = edited([r[:2] for r in rows])
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got) == sorted((len(t), sha(e)) for t, e in want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["fingerprint"] == by_id[8]["fingerprint"] != by_id[10]["fingerprint"]
    assert by_id[0]["fingerprint"] == by_id[2]["fingerprint"] == "--" * fingerprints.BINS
    assert by_id[7]["near_next"] == 1.0 and by_id[2]["near_next"] == 0.0


def test_estimates(spark):
    rng = random.Random(4)
    rows = [(3 * i, sentence(rng, rng.choice((6, 30, 200, 900))), None, None, None) for i in range(200)]
    got = {r["n_chars"]: r for r in fingerprints.edited_fingerprints(documents(spark, rows)).collect()}
    misses = []
    for text, changed in edited([r[:2] for r in rows]):
        a, b = shingles(text), shingles(changed)
        misses.append(got[len(text)]["near_edited"] - len(a & b) / len(a | b))
    # without bias, and as near as 128 bins allow
    assert abs(sum(misses) / len(misses)) < 0.02
    assert max(map(abs, misses)) < 0.25


def test_neighbours_across_ranges(spark):
    rows = [(i * i, f"text {i}", None, None, None) for i in range(500)]
    pairs = fingerprints.with_next(
        documents(spark, rows).withColumn("body", F.col("text")), ["body"]
    ).collect()
    assert sorted((r["doc_id"], r["next_body"]) for r in pairs) == [
        (i * i, f"text {(i + 1) % 500}") for i in range(500)
    ]


def test_one_row_and_none(spark):
    one = fingerprints.edited_fingerprints(documents(spark, [(5, "a b c d e f g h", None, None, None)])).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(documents(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = fingerprints.edited_fingerprints(documents(spark, edge_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

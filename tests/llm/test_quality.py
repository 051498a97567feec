import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from evalspark.llm import quality
from evalspark.llm import queries
from llm.samples import CLASHES, documents, edge_rows, sentence

SF_DIR = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_weights_recover_preferences():
    rng = np.random.default_rng(1)
    rows = np.hstack([rng.normal(size=(800, 6)), np.full((800, 1), 1e9)])
    truth = np.array([2.0, -1.0, 0.5, 0, 0, 0])
    wanted = (rows[:, :-1] @ truth + rng.logistic(size=800) > 0.7).astype(int)
    model = quality.fit_preferences(rows, wanted)
    assert model.weights[0] > 0 > model.weights[1]
    # the threshold cuts off the share of rejected rows
    assert abs((model.score(rows) >= 0.5).mean() - wanted.mean()) < 0.01


def test_held_out_accuracy(spark):
    got = queries.op10_quality(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len(held) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_edges(spark):
    rng = random.Random(1)
    rows = edge_rows() + [
        (1000 + i, sentence(rng, 30) if i % 2 else "### $$$ " * 40, None, None, None) for i in range(300)
    ]
    marks = [(1000 + i, i % 2, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0), (1001, None, 0), (1003, 7, 0), (99999, 1, 0)]
    scored = quality.score_quality(documents(spark, rows, clashing=True), labels(spark, marks))
    assert set(CLASHES) <= set(scored.columns) and len(scored.columns) == len(set(scored.columns))
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if (r["doc_id"] or 0) >= 1000)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, edge_rows())
    for marks in ([], [(3, 1, 0)]):
        assert {r["score"] for r in quality.score_quality(docs, labels(spark, marks)).collect()} == {0.5}
    assert quality.score_quality(documents(spark, []), labels(spark, [])).count() == 0


def test_held_out_rows_never_train(spark):
    held = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = documents(spark, [(i, "good text" if i % 2 else "bad", None, None, None) for i in held])
    marks = labels(spark, [(i, i % 2, 0) for i in held])
    assert docs.where(~quality.is_held_out(F.col("doc_id"))).count() == 0
    assert not quality.train(docs, marks).weights.any()


def test_layout_and_bound_of_the_sample(spark):
    rng = random.Random(2)
    # the share of quality 0 is a tenth, whatever the sample
    rows = [
        (i, "### $$$ " * rng.randint(3, 9) if i % 10 == 0 else sentence(rng, rng.randint(5, 60)), None, None, None)
        for i in range(1_500)
    ]
    marks = labels(spark, [(i, int(i % 10 != 0), 0) for i in range(1_500)])
    docs = documents(spark, rows)
    scores = []
    for order in (docs, docs.repartition(13).orderBy(F.xxhash64("doc_id"))):
        scored = quality.score_quality(order, marks, per_class=40)
        scores.append({r["doc_id"]: r["score"] for r in scored.collect()})
    assert scores[0] == scores[1]
    learned = [s for i, s in scores[0].items() if zlib.crc32(str(i).encode()) % 3 != 1]
    bad = sum(i % 10 == 0 and zlib.crc32(str(i).encode()) % 3 != 1 for i in scores[0])
    assert sum(s < 0.5 for s in learned) == bad


def test_threshold_is_a_quantile_of_all_labels(spark):
    rng = random.Random(3)
    # noisy labels: the scores of the qualities overlap
    rows = [(i, sentence(rng, 20) + " $$" * rng.randint(0, 9), None, None, None) for i in range(1_200)]
    marks = [(i, int(rng.random() > (0.1 + 0.04 * rows[i][1].count("$$"))), 0) for i in range(1_200)]
    docs, table = documents(spark, rows), labels(spark, marks)
    model = quality.train(docs, table, per_class=30)
    held = {i for i in range(1_200) if zlib.crc32(str(i).encode()) % 3 == 1}
    own = sorted(
        float(model.rank(quality.features(t.encode())[None])[0]) for i, t, *_ in rows if i not in held
    )
    bad = sum(q == 0 for i, q, _ in marks if i not in held)
    assert abs(model.threshold - (own[bad - 1] + own[bad]) / 2) < 1e-9


def test_repeated_ids(spark):
    rows = [(5, "b $$$", None, None, None)] * 300 + [(5, "a ###", None, None, None), (6, None, None, None, None)]
    rows += [(7 + i, "some words of plain text.", None, None, None) for i in range(20)]
    marks = labels(spark, [(5, 0, 0), (6, 0, 0)] + [(7 + i, 1, 0) for i in range(20)])
    docs = documents(spark, rows)
    first = {r["text"]: r["score"] for r in quality.score_quality(docs, marks).collect()}
    again = {r["text"]: r["score"] for r in quality.score_quality(docs.repartition(9), marks).collect()}
    assert first == again

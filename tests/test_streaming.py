"""History by key, state of metrics, and the stream that uses both."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators.judging import judge
from evalspark.plans.benchmark import run_metrics
from evalspark.queries.models import make_containing_judge
from evalspark.streaming.history import KeyedHistory, Segment
from evalspark.streaming import incremental
from evalspark.streaming import state as state_module
from evalspark.streaming.incremental import evaluate_stream, metric_state, stream_metrics, verdict_history
from evalspark.streaming.state import MetricState

SCHEMA = "kind string, id string, n bigint"


def history(spark, path):
    return KeyedHistory(spark, str(path), ["kind", "id"], SCHEMA, buckets=8)


def one(batch):
    return Segment(batch, batch)


def rows_of(spark, ids, n=0):
    return spark.createDataFrame([("k", str(i), n) for i in ids], SCHEMA)


def test_history_finds_the_latest_row(spark, tmp_path):
    h = history(spark, tmp_path / "h")
    assert h.segments() == [] and h.candidates(rows_of(spark, [1])).count() == 0
    h.add(rows_of(spark, range(0, 200), 1), 0)
    h.add(rows_of(spark, range(100, 300), 2), 1)
    h.add(rows_of(spark, [], 3), 2)
    assert h.segments() == [one(0), one(1), one(2)]
    wanted = rows_of(spark, [5, 150, 299, 1000])
    assert sorted(map(tuple, h.latest(wanted).collect())) == [("k", "150", 2), ("k", "299", 2), ("k", "5", 1)]
    assert sorted(map(tuple, h.latest(wanted, [one(0)]).collect())) == [("k", "150", 1), ("k", "5", 1)]
    # a batch written again has no rows of its former self
    h.add(rows_of(spark, [7], 9), 1)
    assert sorted(map(tuple, h.latest(rows_of(spark, [7, 150, 299])).collect())) == [("k", "150", 1), ("k", "7", 9)]
    nothing = spark.createDataFrame([(None, "7", 0)], SCHEMA)
    assert h.latest(nothing).count() == 0


def test_only_buckets_that_may_have_a_key_are_opened(spark, tmp_path):
    h = history(spark, tmp_path / "h")
    opened = []
    for batch in range(50):
        ids = range(batch * 40, batch * 40 + 40)
        if batch % 12 == 0:
            found = h.candidates(rows_of(spark, ids))
            opened.append(sum(len(open(f.removeprefix("file://"), "rb").read()) for f in found.inputFiles()))
        h.add(rows_of(spark, ids), batch)
    # new keys: however long the history, next to nothing of it is read
    one = max(f.stat().st_size for f in (tmp_path / "h/rows").rglob("*.parquet"))
    assert max(opened) <= 3 * one
    again = h.candidates(rows_of(spark, [45]))
    folders = {"/".join(f.split("/")[-3:-1]) for f in again.inputFiles()}
    assert any(f.startswith("segment=1-1/") for f in folders) and len(folders) <= 2
    assert again.where("id = '45'").count() == 1


def test_merged_batches_answer_as_before(spark, tmp_path):
    h = history(spark, tmp_path / "h")
    for batch in range(6):
        h.add(rows_of(spark, range(batch * 5, batch * 5 + 20), batch), batch)
    wanted = rows_of(spark, range(60))
    want = sorted(map(tuple, h.latest(wanted).collect()))
    h.merge(10, before=5)
    assert len(h.segments()) == 6
    h.merge(4, before=5)
    assert h.segments() == [Segment(0, 4), one(5)]
    assert sorted(map(tuple, h.latest(wanted).collect())) == want
    assert len(list((tmp_path / "h/rows").iterdir())) == len(list((tmp_path / "h/filters").iterdir())) == 2
    assert h.knows(3) and not h.knows(6)
    # the last batch may come again, merged ones can't
    h.add(rows_of(spark, [1], 9), 5)
    assert h.latest(rows_of(spark, [1])).first()["n"] == 9 and h.others(5) == [Segment(0, 4)]
    with pytest.raises(ValueError, match="older than the history"):
        h.others(3)
    # a merge that broke off before the old batches were deleted
    h.add(rows_of(spark, [2], 77), 2)
    assert h.segments() == [Segment(0, 4), one(5)]


def test_faults_are_not_an_empty_history(spark, tmp_path):
    h = history(spark, tmp_path / "h")
    h.add(rows_of(spark, range(5)), 0)
    for file in (tmp_path / "h/filters").rglob("*.parquet"):
        file.write_bytes(b"broken")
    for file in (tmp_path / "h/filters").rglob(".*.crc"):
        file.unlink()
    with pytest.raises(Exception, match="(?i)parquet|corrupt|read"):
        h.candidates(rows_of(spark, [1])).collect()


COLUMNS = [
    "dataset", "total_samples", "correct_samples", "accuracy", "pass_at_1", "pass_at_2", "pass_at_5", "total_tokens",
    "avg_tokens_per_sample", "avg_tokens_per_correct", "token_efficiency", "avg_confidence", "min_confidence",
    "max_confidence", "problem_count",
]


def plain(df):
    return sorted(
        [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*COLUMNS).collect()], key=repr
    )


def verdicts(spark, rng, n):
    rows = [
        (rng.choice(["a", "b", ""]), f"p{rng.randrange(12)}", rng.random() < 0.4, rng.randrange(100),
         rng.choice([None, rng.randrange(8) / 8]))
        for _ in range(n)
    ]
    return spark.createDataFrame(
        rows, "dataset string, id string, is_correct boolean, tokens_used bigint, evaluation_confidence double"
    )


def test_state_equals_all_verdicts(spark, tmp_path):
    rng = random.Random(3)
    state = MetricState(spark, str(tmp_path / "s"))
    assert state.metrics().count() == 0
    batches, ks = [], (1, 2, 5)
    for number, size in enumerate((30, 0, 60)):
        batches.append(verdicts(spark, rng, size))
        state.update(batches[-1], number)
        all_rows = batches[0]
        for other in batches[1:]:
            all_rows = all_rows.unionByName(other)
        want = plain(run_metrics(all_rows, ks, ("dataset",)))
        assert plain(state.metrics(ks)) == want
        # the batch once more, as after a failure before the stream noted it
        state.update(batches[-1], number)
        assert plain(state.metrics(ks)) == want
    assert state.versions() == [0, 1, 2]
    first = run_metrics(batches[0], ks, ("dataset",))
    assert plain(state.metrics(ks, version=0)) == plain(first)


def test_state_of_a_problem_with_most_rows(spark, tmp_path):
    state = MetricState(spark, str(tmp_path / "s"))
    for batch in range(3):
        rows = spark.range(5_000).selectExpr(
            "'d' AS dataset", "if(id % 3 > 0, 'hot', string(id)) AS id", "id % 2 = 0 AS is_correct", "id AS tokens_used"
        )
        state.update(rows, batch)
    got = state.metrics((1,)).first()
    assert (got["total_samples"], got["problem_count"]) == (15_000, 1_668)


def judged(responses):
    return judge(responses, make_containing_judge)


def response(i, **more):
    return {"id": f"x{i}", "problem": "p", "answer": "5", "model_output": "It is 5" if i % 3 else "no", "tokens_used": i, **more}


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_keeps_history_and_state(spark, tmp_path, monkeypatch):
    results, out, checkpoint = tmp_path / "results", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder = results / "aa_responses.jsonl"

    def run():
        evaluate_stream(spark, str(results), out, judged, checkpoint, files_per_trigger=1).awaitTermination()
        got = plain(metric_state(spark, out).metrics((1, 2, 5)))
        assert got == plain(stream_metrics(spark, out, (1, 2, 5)))
        return got

    monkeypatch.setattr(incremental, "MERGED_BATCHES", 2)
    monkeypatch.setattr(state_module, "MERGED_BATCHES", 2)
    for part in range(4):
        write(folder / f"part-{part}", [response(i, generation_id=g) for i in range(part * 4, part * 4 + 6) for g in (0, part)])
        run()
    assert run()[0][1] == spark.read.parquet(f"{out}/verdicts").dropDuplicates(["id", "generation_id"]).count()
    assert verdict_history(spark, out).segments() == [Segment(0, 2), one(3)]


def test_verdicts_without_history_are_taken_in(spark, tmp_path):
    results, out = tmp_path / "results", str(tmp_path / "out")
    write(results / "aa_responses.jsonl", [response(i) for i in range(6)])
    evaluate_stream(spark, str(results), out, judged, str(tmp_path / "one")).awaitTermination()
    moved = spark.read.parquet(f"{out}/verdicts").drop("batch_id")
    old = str(tmp_path / "old")
    moved.withColumn("batch_id", F.lit(7)).write.partitionBy("batch_id").parquet(f"{old}/verdicts")
    write(results / "bb_responses.jsonl", [response(1)])
    evaluate_stream(spark, str(results), old, judged, str(tmp_path / "two")).awaitTermination()
    assert verdict_history(spark, old).segments() == [one(0), one(7)]
    got = spark.read.parquet(f"{old}/verdicts").groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in got} == {"aa": 6, "bb": 1}


def test_a_batch_costs_the_same_however_many_came_before(spark, tmp_path, monkeypatch):
    results, listed, parts = tmp_path / "results", [], []
    for part in range(3):
        write(results / f"aa_responses.jsonl/part-{part}", [response(part * 9 + i) for i in range(12)])
    known = incremental.partition_values
    monkeypatch.setattr(incremental, "partition_values", lambda *a: listed.append(a[1]) or known(*a))

    def counted(responses):
        parts.append(responses.rdd.getNumPartitions())
        return judged(responses)

    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        evaluate_stream(
            spark, str(results), str(tmp_path / "out"), counted, str(tmp_path / "checkpoint"), files_per_trigger=1
        ).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.read.parquet(str(tmp_path / "out/verdicts")).count() == 30
    # tasks by rows and cores, not by the setting for large shuffles; earlier verdicts are listed at the start only
    assert len(parts) == 3 and max(parts) <= spark.sparkContext.defaultParallelism
    assert len(listed) == 1


def test_merging_leaves_large_segments_alone(spark, tmp_path):
    h = history(spark, tmp_path / "h")
    # only names count: the rows of a segment that stays aren't read
    kept = []
    state = {"segments": [Segment(0, 9), *[one(b) for b in range(10, 17)]]}
    h.segments = lambda: state["segments"]
    h.rows_in = lambda folders: kept.extend(folders) or rows_of(spark, []).withColumn("batch_id", F.lit(0).cast("bigint"))
    written = []
    h._write = lambda rows, segment: written.append(segment)
    h.merge(8, before=17)
    assert written == [Segment(10, 16)] and len(kept) == 7 and not any("0-9" in f for f in kept)
    state["segments"] = [Segment(0, 9), Segment(10, 16), *[one(b) for b in range(17, 23)]]
    h.merge(8, before=23)
    assert written[1] == Segment(0, 22)


def test_the_version_before_a_batch_may_be_older(spark, tmp_path):
    state = MetricState(spark, str(tmp_path / "s"))
    for version in (0, 3):
        (tmp_path / f"s/sums/batch_id={version}").mkdir(parents=True)
    assert [state._before(b) for b in (0, 1, 3, 4, 9)] == [None, 0, 0, 3, 3]

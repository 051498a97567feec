import json
import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import compare, metrics
from evalspark.operators.keyed_joins import with_templates
from evalspark.operators.percentiles import approximate_percentiles, percentiles
from evalspark.operators.sampling import sample_n

SCHEMA = "dataset string, sample_id string, is_correct boolean, tokens_used bigint, confidence double"


def random_rows(seed=1, n=400):
    """A third of the rows belongs to one problem of one dataset."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        dataset = "a" if hot else rng.choice("abc")
        sample = "hot" if hot else f"s{rng.randrange(60)}"
        confidence = rng.random() if rng.random() < 0.7 and dataset != "c" else None
        rows.append((dataset, sample, rng.random() < 0.4, rng.randrange(0, 90), confidence))
    return rows


def expected(rows, ks=(1, 3, 5)):
    problems = defaultdict(list)
    for row in rows:
        problems[row[1]].append(row[2])
    correct = [r for r in rows if r[2]]
    tokens = sum(r[3] for r in rows)
    conf = [r[4] for r in rows if r[4] is not None]
    out = {
        "total_samples": len(rows),
        "correct_samples": len(correct),
        "accuracy": len(correct) / len(rows),
        "total_tokens": tokens,
        "avg_tokens_per_sample": tokens / len(rows),
        "avg_tokens_per_correct": sum(r[3] for r in correct) / len(correct) if correct else 0.0,
        "token_efficiency": len(correct) / tokens if tokens else 0.0,
        "avg_confidence": sum(conf) / len(conf) if conf else None,
        "min_confidence": min(conf) if conf else None,
        "max_confidence": max(conf) if conf else None,
        "problem_count": len(problems),
    }
    for k in ks:
        scores = [
            1.0 if len(p) - sum(p) < k else 1 - math.comb(len(p) - sum(p), k) / math.comb(len(p), k)
            for p in problems.values()
            if len(p) >= k
        ]
        out[f"pass_at_{k}"] = sum(scores) / len(scores) if scores else 0.0
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("partitions", [1, 7])
def test_comprehensive(spark, partitions):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r.dataset: r.asDict() for r in metrics.comprehensive(df).collect()}
    assert set(got) == {"a", "b", "c"}
    for dataset, row in got.items():
        want = expected([r for r in rows if r[0] == dataset])
        for key, value in want.items():
            assert close(row[key], value), (dataset, key, row[key], value)
    for table in (metrics.pass_at_k_table, metrics.token_metrics, metrics.accuracy, metrics.problem_count):
        for r in table(df, ["dataset"]).collect():
            for key in r.asDict().keys() - {"dataset"}:
                assert close(r[key], got[r.dataset][key]), key


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert metrics.accuracy(df).first().accuracy == 0.0
    tokens = metrics.token_metrics(df).first()
    assert tokens.avg_tokens_per_sample == tokens.token_efficiency == tokens.total_tokens == 0
    assert metrics.confidence_metrics(df).first().asDict() == {
        "avg_confidence": 0.0, "min_confidence": 0.0, "max_confidence": 0.0, "std_confidence": 0.0,
    }
    assert metrics.comprehensive(df).count() == 0
    assert percentiles(df, "confidence").first().asDict() == dict.fromkeys(["p25", "p50", "p75", "p90", "p95"], 0.0)


def test_zero_tokens_and_no_correct(spark):
    df = spark.createDataFrame([("a", "x", False, 0, None)], SCHEMA)
    row = metrics.comprehensive(df).first()
    assert (row.token_efficiency, row.avg_tokens_per_correct, row.pass_at_1, row.pass_at_3) == (0, 0, 0, 0)
    assert row.avg_confidence is None


def test_metric_rows(spark):
    df = spark.createDataFrame(
        [("d", "i", None, None, (5,))],
        "dataset string, id string, is_correct boolean, tokens_used bigint, evaluation_metadata struct<tokens_used:bigint>",
    )
    assert metrics.metric_rows(df).first().asDict() == {
        "dataset": "d", "sample_id": "i", "is_correct": False, "tokens_used": 0, "confidence": None,
    }
    judged = metrics.metric_rows(df, tokens="evaluation_metadata.tokens_used")
    assert judged.first().tokens_used == 5


def test_groups(spark):
    rows = random_rows(5)
    groups = [("g1", "hot"), ("g1", "s1"), ("g2", "hot"), ("g2", "hot"), ("g3", "nobody")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = metrics.group_metrics(df, spark.createDataFrame(groups, "group_name string, sample_id string"))
    want = {}
    for name in ("g1", "g2"):
        members = {s for g, s in groups if g == name}
        inside = [r for r in rows if r[1] in members]
        want[name] = (len(inside), sum(r[2] for r in inside))
    assert {r.group_name: (r["count"], r.correct_count) for r in got.collect()} == want


def test_attribute_groups_keep_nulls_apart(spark):
    df = spark.createDataFrame(
        [("a", "x", True), ("a", None, False), ("a", "x", False)],
        "dataset string, level string, is_correct boolean",
    )
    got = {
        (r.level, r.is_overall): (r["count"], r.correct_count)
        for r in metrics.attribute_metrics(df, ["dataset"], "level").collect()
    }
    assert got == {(None, True): (3, 1), (None, False): (1, 0), ("x", False): (2, 1)}


def test_judge_statistics(spark):
    df = spark.createDataFrame([("Correct",), ("[Correct]",), ("incorrect ",), (None,)], "judgment string")
    row = metrics.judge_statistics(df).first()
    assert (row.valid_num, row.correct_num, row.incorrect_num, row.accuracy) == (2, 1, 1, 0.25)
    assert metrics.judge_statistics(df.limit(0)).first().accuracy == 0.0


def test_documents(spark):
    df = spark.createDataFrame(random_rows(2), SCHEMA)
    documents = metrics.metrics_documents(metrics.comprehensive(df))
    got = {r.dataset: json.loads(r.document) for r in documents.collect()}
    assert set(got["a"]) == {
        "overall", "token_efficiency", "group_metrics", "confidence_metrics", "problem_count", "dataset_info",
    }
    assert set(got["a"]["overall"]["pass_at_k"]) == {"1", "3", "5"}
    assert got["c"]["confidence_metrics"] == {} and len(got["a"]["confidence_metrics"]) == 3
    assert got["b"]["group_metrics"] == {} and got["b"]["dataset_info"]["name"] == "b"


def interpolate(values, p):
    values = sorted(values)
    index = p / 100 * (len(values) - 1)
    low = int(index)
    if low + 1 == len(values):
        return values[-1]
    return values[low] + (values[low + 1] - values[low]) * (index - low)


def test_percentiles(spark):
    rng = random.Random(4)
    rows = [("hot", 1.0)] * 300 + [("hot", rng.random() * 100) for _ in range(200)]
    rows += [("one", 5.0), (None, 2.0), (None, 4.0), ("gone", None)]
    rows += [("many", float(i)) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    percents = (0, 25, 50, 75, 90, 95, 100)
    got = {r.g: r for r in percentiles(df, "v", ["g"], percents).collect()}
    assert set(got) == {"hot", "one", None, "many"}
    for group, row in got.items():
        values = [v for g, v in rows if g == group]
        for p in percents:
            assert close(row[f"p{p}"], interpolate(values, p)), (group, p)
    rough = {r.g: r for r in approximate_percentiles(df, "v", ["g"]).collect()}
    assert abs(rough["many"].p50 - got["many"].p50) < 100


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_percentiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = percentiles(df, "v").first()
    gathered = percentiles(df, "v").first()
    for p in (25, 50, 75, 90, 95):
        want = interpolate([float(v) for v in values], p)
        assert close(row[f"p{p}"], want) and close(gathered[f"p{p}"], want)


def test_sampling_is_the_same_either_way(spark, monkeypatch):
    df = spark.range(3000).repartition(9)
    small = {r.id for r in sample_n(df, ["id"], 700, 5).collect()}
    monkeypatch.setattr("evalspark.operators.sampling.HEAP_LIMIT", 2)
    large = {r.id for r in sample_n(df.repartition(3), ["id"], 700, 5).collect()}
    assert small == large and len(small) == 700
    assert sample_n(df, ["id"], 5000, 5).count() == 3000
    assert sample_n(df, ["id"], 0, 5).count() == 0


def test_comparison(spark):
    rows = [("x", "m1", 0.0625, 16, 0.5, 0.75), ("x", "m2", 1.0, 4, 1.0, 0.0), ("y", "m2", 0.5, 2, 0.5, 0.0)]
    df = spark.createDataFrame(
        rows, "dataset string, model string, accuracy double, total_samples bigint, pass_at_1 double, pass_at_3 double"
    )
    grid = compare.comparison_grid(df, ["m2", "m1"])
    assert grid.count() == 4
    lines = compare.report_lines(grid).orderBy("dataset", "line_no", "model").collect()
    assert [r.line for r in lines if r.dataset == "x"] == [
        "## X",
        "",
        "| Model | Accuracy | Pass@1 | Pass@3 | Samples |",
        "|-------|----------|--------|--------|---------|",
        "| m1 | 0.062 | 0.500 | 0.750 | 16 |",
        "| m2 | 1.000 | 1.000 | 0.000 | 4 |",
        "",
    ]
    assert "| m1 | - | - | - | - |" in [r.line for r in lines if r.dataset == "y"]
    docs = {(r.dataset, r.model): r.document for r in compare.comparison_documents(grid).collect()}
    assert docs["y", "m1"] == "null" and json.loads(docs["x", "m1"])["total_samples"] == 16


def test_templates(spark):
    prompts = spark.createDataFrame([("j1", "q"), ("j2", "r")], "judge_name string, prompt string")
    templates = spark.createDataFrame([("j1", "<{query}>")], "judge_name string, template string")
    assert with_templates(prompts.filter("judge_name = 'j1'"), templates).first().template == "<{query}>"
    with pytest.raises(Exception, match="Missing template for judge j2"):
        with_templates(prompts, templates).collect()


def test_sampling_needs_row_keys(spark, monkeypatch):
    monkeypatch.setattr("evalspark.operators.sampling.HEAP_LIMIT", 2)
    df = spark.range(9).withColumn("same", F.lit(1))
    with pytest.raises(ValueError, match="identify a row"):
        sample_n(df, ["same"], 5)

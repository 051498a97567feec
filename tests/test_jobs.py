import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators.inference import generate
from evalspark.operators.judging import judge, verdicts_from_column
from evalspark.operators.quality import (
    expected_file_check,
    is_complete,
    loader_check,
    raw_check,
    requested_datasets,
)
from evalspark.operators.normalize import normalize
from evalspark.plans.benchmark import BenchmarkSettings, run_benchmark
from evalspark.plans.comparison import compare_runs
from evalspark.plans.file_judge import judge_file
from evalspark.plans.migration import check_migrated, migrate, migrated_samples
from evalspark.plans.reevaluate import reevaluate
from evalspark.plans.validation import simple_validate, validate
from evalspark.queries.models import make_containing_judge, make_echo_model
from evalspark.schema import GenerationConfig
from evalspark.sinks.tables import read_run_table, register_run, write_run_table
from evalspark.sources.catalogue import file_inventory
from evalspark.streaming.incremental import evaluate_stream, stream_metrics


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def lines(spark, values):
    rows = [("f", i, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, line_idx bigint, rec_idx bigint, value string")


GOOD = '{"problem":"p","answer":"a"}'


@pytest.mark.parametrize(
    "values, ok, message",
    [
        ([GOOD, GOOD], True, "Valid JSONL with 2 samples checked"),
        ([GOOD, '{"answer":1}', '{"problem":1}'], False, "Missing required field 'problem' in sample 1"),
        (['{"problem":1}'], False, "Missing required field 'answer' in sample 0"),
        ([GOOD, '{"problem":"p","answer":0}'], False, "Empty required field in sample 1"),
        (['{"problem":null,"answer":1}'], False, "Empty required field in sample 0"),
        (['{"answer":1}', GOOD, "{bad"], False, "JSON decode error in line 3"),
        ([GOOD] * 5 + ["{bad"], False, "JSON decode error in line 6"),
    ],
)
def test_raw_check(spark, values, ok, message):
    row = raw_check(lines(spark, values), ["file"]).first()
    assert (row.ok, row.message) == (ok, message)


def test_raw_check_of_first_lines(spark):
    row = raw_check(lines(spark, [GOOD] * 5 + ["{bad"]), ["file"], max_lines=5).first()
    assert (row.ok, row.message) == (True, "Valid JSONL with 5 samples checked")


def test_is_complete(spark):
    values = ['{"question":"q","answer":"a"}', '{"question":"","answer":"a"}', '{"question":"q"}', "{bad"]
    got = lines(spark, values).select(is_complete(F.try_parse_json("value")).alias("c")).collect()
    assert [r.c for r in got] == [True, False, False, False]


def test_loader_check(spark):
    raw = lines(spark, ["{}"]).withColumn("split", F.lit("test"))
    rows = normalize(raw, "amc").unionByName(normalize(raw, "math"))
    names = spark.createDataFrame([("amc",), ("math",), ("gpqa",), ("zzz",)], "dataset string")
    got = {r.dataset: (r.ok, r.message) for r in loader_check(rows, names).collect()}
    assert got == {
        "amc": (True, "Successfully loaded 1 samples using amc loader"),
        "math": (True, "Successfully loaded 1 samples using math loader"),
        "gpqa": (False, "No samples loaded"),
        "zzz": (False, "Unknown dataset: zzz"),
    }


def test_requested(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "dataset string")
    b = spark.createDataFrame([("x",), ("z",)], "dataset string")
    selected, missing = requested_datasets(a, b)
    assert [r.dataset for r in selected.collect()] == ["x"]
    assert [r.dataset for r in missing.collect()] == ["y"]


# --- model calls ------------------------------------------------------------------------


def test_generate(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "i int, prompt string").repartition(3)
    config = GenerationConfig(n=2, max_tokens=30)
    rows = generate(df, make_echo_model, config, batch_size=7).collect()
    assert len(rows) == 80
    for r in rows:
        if r.generation_id == 0:
            assert r.model_output == "0: " + "x" * r.i and r.tokens_used == r.i
            assert r.finish_reason == ("length" if r.i >= 30 else "stop")
        else:
            assert r.finish_reason == "eos"


def test_generate_calls_in_batches_and_checks_counts(spark):
    def make_counting():
        return lambda prompts, config: [[{"text": str(len(prompts)), "tokens_used": 1}] for _ in prompts]

    df = spark.createDataFrame([(i, "p") for i in range(10)], "i int, prompt string").coalesce(1)
    sizes = [r.model_output for r in generate(df, make_counting, batch_size=4).orderBy("i").collect()]
    assert sizes == ["4"] * 8 + ["2"] * 2

    def make_short():
        return lambda prompts, config: []

    with pytest.raises(Exception, match="one list of results per prompt"):
        generate(df, make_short).collect()


def test_only_the_prompt_crosses_to_python(spark):
    df = spark.createDataFrame([(1, "p", "big")], "i int, prompt string, other string")
    plan = generate(df, make_echo_model)._jdf.queryExecution().executedPlan().toString()
    node = next(line for line in plan.split("\n") if "ArrowEvalPython" in line)
    assert "call(prompt" in node and "call(other" not in node and "MapInPandas" not in plan


def test_judge(spark):
    df = spark.createDataFrame(
        [("q", "5", "x</think> it is 5"), ("q", "7", "7</think> it is 5"), (None, None, "None")],
        "problem string, answer string, model_output string",
    )
    rows = judge(df, make_containing_judge).collect()
    assert [r.is_correct for r in rows] == [True, False, True]
    assert rows[0].evaluation_reasoning == "[Correct]" and rows[0].evaluation_metadata.tokens_used == 9
    assert rows[0].evaluation_confidence is None
    raw = judge(df, make_containing_judge, clean=False).collect()
    assert [r.is_correct for r in raw] == [True, True, True]
    exact = judge(df, make_containing_judge, mode="exact").collect()
    assert [r.is_correct for r in exact] == [False, False, False]
    given = verdicts_from_column(df.withColumn("v", F.lit("correct")), "v").collect()
    assert all(r.is_correct for r in given)


def test_judge_file(spark, tmp_path):
    records = [{"question": "q", "llm_output": f"it is {i}", "correct_answer": "3"} for i in range(5)]
    write(tmp_path / "data.json", [json.dumps(records)])

    def make_plain():
        judge_ = make_containing_judge()
        return lambda p, c: [[{"text": r[0]["text"].strip("[]"), "tokens_used": 1}] for r in judge_(p, c)]

    row = judge_file(spark, str(tmp_path / "data.json"), str(tmp_path / "out"), make_plain, "j", "r1").first()
    assert (row.valid_num, row.correct_num, row.incorrect_num, row.accuracy) == (5, 1, 4, 0.2)
    info = spark.read.parquet(str(tmp_path / "out" / "info")).first()
    assert (info.dataset, info.data_num, info.run_id) == ("data", 5, "r1")
    results = spark.read.parquet(str(tmp_path / "out" / "results"))
    assert {r.judge_valid for r in results.collect()} == {"True"}
    two = judge_file(spark, str(tmp_path / "data.json"), str(tmp_path / "out"), make_plain, "j", "r2", data_size=2)
    assert two.first().incorrect_num == 2


# --- jobs -------------------------------------------------------------------------------


@pytest.fixture
def data_dir(tmp_path):
    root = tmp_path / "data"
    write(root / "amc" / "test.jsonl", [{"problem": "add 1", "answer": 27.0}, {"problem": "b", "answer": "zz"}])
    write(root / "math" / "test.jsonl", [{"problem": "p", "solution": r"\boxed{p}"}, "{bad", {"problem": "q", "solution": 4}])
    write(root / "notes" / "readme.txt", ["hello"])
    return root


def test_benchmark_and_comparison(spark, tmp_path, data_dir):
    out = str(tmp_path / "out")

    def run(run_id, model, names, **more):
        settings = BenchmarkSettings(str(data_dir), names, out, model, run_id=run_id, **more)
        return run_benchmark(spark, settings, make_echo_model, make_containing_judge)

    rows = {r.dataset: r for r in run("1", "org/m1", ("amc", "math")).collect()}
    assert (rows["amc"].total_samples, rows["amc"].correct_samples) == (2, 0)
    assert (rows["math"].total_samples, rows["math"].accuracy, rows["math"].model) == (1, 1.0, "m1")
    samples = read_run_table(spark, f"{out}/samples", "1")
    assert sorted(r.error for r in samples.filter("error is not null").collect()) == [
        "answer is not text", "malformed JSON",
    ]
    # a run written again replaces itself
    run("1", "org/m1", ("amc", "math"))
    assert read_run_table(spark, f"{out}/results", "1").count() == 3
    strict = run("2", "org/m2", ("amc", "math"), strict=True, generation=GenerationConfig(n=3))
    row = strict.collect()
    assert [r.dataset for r in row] == ["amc"] and row[0].total_samples == 6 and row[0].problem_count == 2
    grid = compare_runs(spark, f"{out}/metrics", ("1", "2"), ("m1", "m2"), f"{out}/comparison")
    got = {(r.dataset, r.model): r.total_samples for r in grid.collect()}
    assert got == {("amc", "m1"): 2, ("amc", "m2"): 6, ("math", "m1"): 1, ("math", "m2"): None}
    report = [r.value for r in spark.read.text(f"{out}/comparison/comparison_report").collect()]
    assert report[:2] == ["# Model Comparison Report", ""]
    assert report.index("## AMC") < report.index("## MATH")
    assert {r.run_id for r in read_run_table(spark, f"{out}/runs").collect()} == {"1", "2"}
    summary = spark.read.json(f"{out}/summary/run_id=1").collect()
    assert {json.loads(r.document)["dataset_info"]["name"] for r in summary} == {"amc", "math"}


def test_register_run_replaces(spark, tmp_path):
    for value in (1, 2):
        register_run(spark, str(tmp_path / "runs"), "r", "a/b", {"k": value})
    rows = read_run_table(spark, str(tmp_path / "runs")).collect()
    assert [(r.model, r.config) for r in rows] == [("b", {"k": "2"})]


def test_validate(spark, data_dir):
    tables = validate(spark, str(data_dir), ["amc", "math", "notes", "absent"])
    got = {r.dataset: (r.file_ok, r.loader_ok, r.valid) for r in tables["datasets"].collect()}
    assert got == {
        "amc": (True, True, True), "math": (False, False, False), "notes": (False, False, False),
    }
    assert [r.dataset for r in tables["missing"].collect()] == ["absent"]
    messages = {r.dataset: r.message for r in tables["files"].collect()}
    assert messages["math"] == "JSON decode error in line 2"
    assert {r.dataset: r.message for r in tables["loader"].collect()}["notes"] == "Unknown dataset: notes"
    assert {r.dataset: r.valid for r in simple_validate(spark, str(data_dir)).collect()} == {
        "amc": True, "math": False, "notes": False,
    }
    inventory = file_inventory(spark, str(data_dir))
    check = expected_file_check(inventory, inventory.select("dataset"))
    assert {r.dataset: r.has_test_file for r in check.collect()} == {"amc": True, "math": True, "notes": False}


def test_migrate(spark, tmp_path, data_dir):
    target = str(tmp_path / "table")

    def status(**options):
        return {r.dataset: (r.status, r.rows, r.unreadable) for r in migrate(spark, str(data_dir), target, **options).collect()}

    dry = status(dry_run=True)
    assert dry["amc"] == ("would migrate", 2, 0) and dry["math"] == ("would migrate", 1, 2)
    assert dry["notes"] == ("unsupported", None, None)
    assert status(requested=["amc", "gone"]) == {"amc": ("migrated", 2, 0), "gone": ("missing", None, None)}
    again = status()
    assert again["amc"][0] == "exists" and again["math"] == ("migrated", 1, 2)
    assert status(requested=["amc"], overwrite=True) == {"amc": ("migrated", 2, 0)}
    assert migrated_samples(spark, target).count() == 3
    assert {r.dataset for r in migrated_samples(spark, target, strict=True).collect()} == {"amc"}
    assert {r.dataset: r.has_test_file for r in check_migrated(spark, str(data_dir)).collect()}["amc"]


def response(i, answer, dataset_output="it is 5"):
    return {"id": f"s{i}", "problem": "q", "answer": answer, "model_output": dataset_output, "tokens_used": 10 + i}


def judged(responses):
    return judge(responses, make_containing_judge)


def test_stream_equals_batch(spark, tmp_path):
    results = tmp_path / "results"
    write(results / "aa_responses.jsonl", [response(i, "5" if i % 2 else "6") for i in range(10)])
    folder = results / "bb_responses.jsonl"
    write(folder / "part-0", [response(i, "5") for i in range(3)] + ["{bad"])
    batch = reevaluate(spark, str(results), str(tmp_path / "batch"), judged, "r")
    out, checkpoint = str(tmp_path / "stream"), str(tmp_path / "checkpoint")

    def run():
        evaluate_stream(spark, str(results), out, judged, checkpoint, files_per_trigger=1).awaitTermination()
        return stream_metrics(spark, out)

    columns = ["dataset", "total_samples", "correct_samples", "total_tokens", "accuracy"]
    want = sorted(map(tuple, batch.select(columns).collect()))
    assert sorted(map(tuple, run().select(columns).collect())) == want
    assert [r.raw for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["{bad"]
    # a later file with copies and one new response adds only the new one
    write(results / "cc_responses.jsonl", [response(i, "5") for i in (0, 0, 0)])
    write(folder / "part-1", [response(i, "5") for i in range(4)])
    again = {r.dataset: r.total_samples for r in run().collect()}
    assert again == {"aa": 10, "bb": 4, "cc": 1}


def test_judge_deals_rows_out(spark):
    rows = spark.range(20).selectExpr(
        "'p' AS problem", "concat('It is ', id) AS model_output", "string(id) AS answer"
    )
    judged = judge(rows.coalesce(1), make_containing_judge, partitions=5)
    assert judged.rdd.getNumPartitions() == 5
    assert judged.filter("is_correct").count() == 20


def test_rewritten_run_has_no_old_datasets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, n int")
    write_run_table(rows, path, "x:1")
    write_run_table(rows.filter("dataset = 'a'"), path, "x:1")
    assert [tuple(r) for r in read_run_table(spark, path, "x:1").select("dataset", "n", "run_id").collect()] == [("a", 1, "x:1")]


def test_broken_run_is_invisible(spark, tmp_path, data_dir):
    from evalspark.queries.models import make_failing_judge
    from evalspark.sinks.commits import committed_runs, manifests

    def run(run_id, judge_factory, model="org/a"):
        settings = BenchmarkSettings(
            data_dir=str(data_dir), datasets=("math",), out_dir=str(tmp_path / "out"), model_path=model, run_id=run_id,
            call_store=str(tmp_path / f"calls {run_id}"),
        )
        return run_benchmark(spark, settings, make_echo_model, judge_factory)

    def grid():
        rows = compare_runs(spark, str(tmp_path / "out/metrics"), ["a b", "r2"], ["a", "b"]).collect()
        return {r["model"]: r["total_samples"] for r in rows}

    run("a b", make_containing_judge)
    whole = grid()["a"]
    with pytest.raises(Exception, match="the judge is gone"):
        run("r2", make_failing_judge, "org/b")
    assert committed_runs(spark, str(tmp_path / "out")) == {"a b"} and grid() == {"a": whole, "b": None}
    assert spark.read.parquet(str(tmp_path / "out/responses/run_id=r2")).count() == whole
    run("r2", make_containing_judge, "org/b")
    assert grid() == {"a": whole, "b": whole}
    stages = {r["stage"]: r["rows"] for r in manifests(spark, str(tmp_path / "out")).where("run_id = 'r2'").collect()}
    assert set(stages) == {"samples", "responses", "results", "metrics"} and stages["results"] == whole
    # a complete run that is written again, and fails, is gone too
    with pytest.raises(Exception, match="the judge is gone"):
        (tmp_path / "calls a b").rename(tmp_path / "other calls")
        run("a b", make_failing_judge)
    assert grid() == {"a": None, "b": whole}


def test_two_writers_of_a_run_conflict(spark, tmp_path):
    from evalspark.sinks.commits import RunConflict, committed_runs, release, run_commit

    out = str(tmp_path / "out")
    spark.range(3).write.parquet(f"{out}/t")
    with run_commit(spark, out, "x/1") as stages:
        stages["t"] = f"{out}/t"
        with pytest.raises(RunConflict):
            with run_commit(spark, out, "x/1"):
                raise AssertionError("not reached")
        assert committed_runs(spark, out) == set()
        with run_commit(spark, out, "other"):
            pass
    assert committed_runs(spark, out) == {"x/1", "other"}
    release(spark, out, "never")

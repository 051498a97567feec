"""Kept model calls and rows dealt by cost."""

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from evalspark.operators.dealing import deal_by_cost
from evalspark.operators.inference import generate, model_column
from evalspark.operators.judging import judge
from evalspark.operators.response_store import call_key, call_store, stored_calls
from evalspark.plans.file_judge import judge_file
from evalspark.queries.models import make_containing_judge
from evalspark.schema import GenerationConfig


def counting_model(folder, fail_on=None):
    """A model that leaves a line for every prompt it is called with."""

    def make():
        import uuid

        def model(prompts, config):
            if fail_on is not None and any(fail_on in str(p) for p in prompts):
                raise RuntimeError("the model is gone")
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write("\n".join(map(str, prompts)) + "\n")
            return [[{"text": f"{p}/{i}", "tokens_used": 1} for i in range(config.n)] for p in prompts]

        return model

    return make


def called(folder):
    return sorted(line for file in folder.iterdir() for line in file.read_text().splitlines())


def test_a_prompt_is_called_once(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'hot', concat('p', id % 20)) AS prompt")
    config = GenerationConfig(n=2)

    def run(df, config=config, name="m"):
        return generate(df, counting_model(calls), config, store=store, model=name)

    half = run(rows.where("id < 10"))
    first = called(calls)
    assert first == sorted({("hot" if i % 3 == 0 else f"p{i % 20}") for i in range(10)})
    got = run(rows)
    assert got.count() == 600 and half.count() == 20
    assert called(calls) == sorted({"hot", *(f"p{i}" for i in range(20))})
    assert {r[0] for r in got.where("prompt = 'hot'").select("model_output").distinct().collect()} == {"hot/0", "hot/1"}
    run(rows)
    assert len(called(calls)) == 21
    # another configuration or model is another call
    run(rows.where("id = 0"), GenerationConfig(n=2, seed=1))
    run(rows.where("id = 0"), name="other")
    assert len(called(calls)) == 23


def test_a_broken_run_goes_on(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    rows = spark.range(60).selectExpr("concat('prompt ', id) AS prompt")
    config = GenerationConfig()

    def run(model):
        return stored_calls(rows, F.col("prompt"), model, config, store, "m", wave_rows=10)

    with pytest.raises(Exception, match="the model is gone"):
        run(counting_model(calls, fail_on="prompt 33"))
    kept = call_store(spark, store).segments()
    before = {r["call"] for r in call_store(spark, store).candidates(
        rows.select(call_key(F.col("prompt"), config, "m").alias("call"))).collect()} if kept else set()
    for file in calls.iterdir():
        file.unlink()
    assert run(counting_model(calls)).count() == 60
    assert len(called(calls)) == 60 - len(before)


def test_null_and_chat_prompts(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(1, None), (2, ""), (3, None)], "id int, prompt string")
    got = generate(rows, counting_model(calls), store=str(tmp_path / "s"))
    assert sorted(r["model_output"] for r in got.collect()) == ["/0", "None/0", "None/0"]
    chat = spark.range(4).select(
        F.array(F.struct(F.lit("user").alias("role"), (F.col("id") % 2).cast("string").alias("content"))).alias("prompt")
    )
    assert generate(chat, counting_model(calls), store=str(tmp_path / "s")).count() == 4
    empty = rows.limit(0)
    assert generate(empty, counting_model(calls), store=str(tmp_path / "t")).count() == 0


def test_tasks_cost_the_same(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(pow(2, id % 14) AS bigint) AS cost").coalesce(3)
    dealt = deal_by_cost(rows, F.col("cost"), 64)
    tasks = dealt.rdd.glom().map(lambda t: (len(t), sum(r["cost"] for r in t), [r["cost"] for r in t])).collect()
    assert len(tasks) == 64 and sum(n for n, _, _ in tasks) == 20_000
    costs = [c for _, c, _ in tasks]
    assert max(costs) < 1.15 * min(costs)
    assert all(order == sorted(order, reverse=True) for _, _, order in tasks)
    odd = spark.createDataFrame([(None,), (-3.0,), (0.0,)], "c double")
    assert deal_by_cost(odd, F.col("c"), 2).count() == 3


def test_one_array_file_is_judged_in_many_tasks(spark, tmp_path):
    import json

    path = tmp_path / "data.json"
    path.write_text(json.dumps([
        {"question": "q", "llm_output": f"It is {i} " + "x" * (i % 50), "correct_answer": str(i)} for i in range(640)
    ]))
    judge_file(spark, str(path), str(tmp_path / "out"), make_containing_judge, "j", "r", partitions=64)
    results = spark.read.parquet(str(tmp_path / "out/results/run_id=r"))
    assert results.where("judgment = '[Correct]'").count() == 640
    assert len(results.inputFiles()) == 64
    none = judge_file(spark, str(tmp_path / "no.json"), str(tmp_path / "out"), make_containing_judge, "j", "none")
    assert none.count() == 0


def test_judge_with_store(spark, tmp_path):
    rows = spark.range(20).selectExpr(
        "'p' AS problem", "concat('It is ', id % 5) AS model_output", "string(id % 5) AS answer"
    )
    store = str(tmp_path / "store")
    judged = judge(rows, make_containing_judge, store=store, judge_name="j")
    assert judged.filter("is_correct").count() == 20
    assert spark.read.parquet(store + "/rows").count() == 5
    assert judge(rows, make_containing_judge, partitions=5).rdd.getNumPartitions() == 5


def test_results_reach_spark_as_arrow(spark):
    """Each result is one list of structs, built by Arrow; keys that a model leaves out are null."""

    def make_model():
        return lambda prompts, config: [[{"text": f"{p}!", "saw_eos": True}, {"text": None, "tokens_used": 2}] for p in prompts]

    prompts = spark.createDataFrame([("a",), (None,)], "prompt string")
    judged = prompts.select("prompt", model_column(F.col("prompt"), make_model, GenerationConfig(n=2), 1).alias("g"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in judged._jdf.queryExecution().executedPlan().toString()
    got = {r["prompt"]: [tuple(g) for g in r["g"]] for r in judged.collect()}
    assert got == {p: [(f"{p}!", None, None, True), (None, 2, None, None)] for p in ("a", None)}

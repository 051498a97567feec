"""Judging of a file of question, output and answer records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.prompts import JUDGE_TEMPLATE, judge_prompt
from evalspark.functions.verdicts import is_valid
from evalspark.operators.dealing import deal_by_cost
from evalspark.operators.inference import ModelFactory, model_column
from evalspark.operators.metrics import judge_statistics
from evalspark.operators.response_store import stored_calls
from evalspark.schema import JUDGE_RECORD_SCHEMA, GenerationConfig
from evalspark.sources.folders import exists
from evalspark.sources.json_array import read_json_array

RECORD_FIELDS = ("question", "llm_output", "correct_answer")


def judge_records(
    records: DataFrame,
    make_judge: ModelFactory,
    judge_name: str,
    template: str = JUDGE_TEMPLATE,
    config: GenerationConfig = GenerationConfig(temperature=0.1, top_p=0.7),
    batch_size: int = 32,
    partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Records with ``prompt``, ``judgment``, ``judge`` and ``judge_valid`` ('True' or 'False').

    ``partitions`` and ``store`` are as in ``judge``.
    """
    prompted = records.withColumn(
        "prompt", judge_prompt(*[F.col(name) for name in RECORD_FIELDS], template=template)
    )
    prompt = F.col("prompt")
    if store is not None:
        called = stored_calls(
            prompted, prompt, make_judge, config, store, judge_name, batch_size, partitions
        ).withColumnRenamed("_generations", "_judged")
    else:
        rows = prompted if partitions is None else deal_by_cost(prompted, F.length(prompt), partitions)
        called = rows.withColumn("_judged", model_column(prompt, make_judge, config, batch_size))
    judgment = F.get("_judged", F.lit(0))["text"]
    return (
        called.withColumn("judgment", judgment)
        .withColumn("judge", F.lit(judge_name))
        .withColumn(
            "judge_valid", F.when(is_valid(F.col("judgment")), "True").otherwise("False")
        )
        .drop("_judged")
    )


def judge_file(
    spark: SparkSession,
    data_path: str,
    out_dir: str,
    make_judge: ModelFactory,
    judge_name: str,
    run_id: str,
    data_size: int | None = None,
    schema: str | None = None,
    config: GenerationConfig = GenerationConfig(temperature=0.1, top_p=0.7),
    partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Judges a JSON-array file; writes tables results, stat_info and info, returns stat_info.

    The file is read in blocks and judged in their tasks, or in ``partitions`` tasks of equal cost. A file
    that doesn't exist has no records.
    """
    out = out_dir.rstrip("/")
    data_name = data_path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if schema is None and not exists(spark, data_path):
        schema = JUDGE_RECORD_SCHEMA
    records = read_json_array(spark, data_path, data_size, schema)
    judged = judge_records(
        records, make_judge, judge_name, config=config, partitions=partitions, store=store
    )
    results_path = f"{out}/results/run_id={run_id}"
    judged.write.mode("overwrite").parquet(results_path)
    results = spark.read.parquet(results_path)
    statistics = judge_statistics(results, "judgment", ["judge"])
    statistics_path = f"{out}/stat_info/run_id={run_id}"
    statistics.write.mode("overwrite").parquet(statistics_path)
    info = results.agg(F.count(F.lit(1)).alias("data_num")).select(
        F.lit(judge_name).alias("model_name"),
        F.lit(config.temperature).alias("temperature"),
        F.lit(config.max_tokens).alias("max_tokens"),
        F.lit(config.top_p).alias("top_p"),
        F.lit(data_name).alias("dataset"),
        "data_num",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
    )
    info.write.mode("overwrite").parquet(f"{out}/info/run_id={run_id}")
    return spark.read.parquet(statistics_path)

"""Tables and files of a run.

Writes keep the partitions of their input: each task writes its own part files, so a large
dataset is written by as many tasks as hold its rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.reporting import run_stamp

RUN_KEYS = ("run_id", "dataset")


def save_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; nulls are written and non-ASCII characters kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def save_by_dataset(df: DataFrame, base: str, name: str, dataset: str, mode: str = "overwrite") -> None:
    """One dataset's rows as ``{base}/{dataset}_{name}.jsonl``."""
    save_jsonl(
        df.filter(F.col("dataset") == dataset), f"{base.rstrip('/')}/{dataset}_{name}.jsonl", mode
    )


def run_folder(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/run_id={quote(run_id, safe='')}"


def write_run_table(df: DataFrame, path: str, run_id: str) -> None:
    """Parquet partitioned by run and dataset; writing a run again replaces all of it, also the
    datasets that it no longer has."""
    (
        df.drop("run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("dataset")
        .parquet(run_folder(path, run_id))
    )


def read_run_table(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The table, or the one run's folder alone."""
    folder = path if run_id is None else run_folder(path, run_id)
    inferred = spark.read.option("basePath", path).parquet(folder).schema
    # partition values such as 20240131_101500 or 007 must stay text
    fields = [
        T.StructField(f.name, T.StringType() if f.name in RUN_KEYS else f.dataType, f.nullable)
        for f in inferred
    ]
    return spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(folder)


def new_run_id(spark: SparkSession, model: str) -> str:
    """``benchmark_eval_{model}_{timestamp}``."""
    stamp = spark.range(1).select(run_stamp(F.current_timestamp())).first()[0]
    return f"benchmark_eval_{model.rsplit('/', 1)[-1]}_{stamp}"


def register_run(
    spark: SparkSession, path: str, run_id: str, model: str, config: Mapping[str, object]
) -> None:
    """One row per run with its configuration; registering a run again replaces the row."""
    row = spark.range(1).select(
        F.lit(model).alias("model_path"),
        F.lit(model.rsplit("/", 1)[-1]).alias("model"),
        F.current_timestamp().alias("started_at"),
        F.create_map(
            *[F.lit(str(x)) for item in sorted(config.items()) for x in item]
        ).cast("map<string,string>").alias("config"),
        F.lit(run_id).alias("run_id"),
    )
    (
        row.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def register_runs(runs: DataFrame, path: str) -> None:
    """Rows of ``run_id, model_path, config`` as runs, all in one write.

    Of several rows of a run the one with the greatest ``started_at`` counts, if the table has this column. Runs that
    were registered before and aren't among the rows stay.
    """
    if "started_at" not in runs.columns:
        runs = runs.withColumn("started_at", F.current_timestamp())
    last = runs.groupBy("run_id").agg(
        F.max(F.struct("started_at", "model_path", F.to_json("config").alias("config"))).alias("_run")
    )
    (
        last.select(
            F.col("_run.model_path").alias("model_path"),
            F.substring_index("_run.model_path", "/", -1).alias("model"),
            F.col("_run.started_at").alias("started_at"),
            F.from_json("_run.config", "map<string,string>").alias("config"),
            "run_id",
        )
        .repartition("run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_text_lines(df: DataFrame, order: list[str], line: str, path: str) -> None:
    """Ordered text; part files read in name order give the whole document."""
    df.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)

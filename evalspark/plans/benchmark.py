"""Benchmark run: read, generate, judge, measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.prompts import JUDGE_TEMPLATE, chat_messages
from evalspark.functions.reporting import iso_stamp
from evalspark.functions.text import short_name
from evalspark.operators.inference import ModelFactory, generate
from evalspark.operators.judging import judge
from evalspark.operators.metrics import (
    DEFAULT_KS,
    comprehensive,
    group_metrics,
    metric_rows,
    metrics_documents,
)
from evalspark.operators.normalize import good_samples, normalize_many
from evalspark.schema import GenerationConfig
from evalspark.sinks.commits import run_commit
from evalspark.sinks.tables import (
    new_run_id,
    read_run_table,
    register_run,
    run_folder,
    save_jsonl,
    write_run_table,
)
from evalspark.sources.jsonl import read_split

METRIC_KEYS = ("run_id", "model", "dataset")


@dataclass(frozen=True)
class BenchmarkSettings:
    data_dir: str
    datasets: Sequence[str]
    out_dir: str
    model_path: str
    split: str = "test"
    max_samples: int | None = None
    system_prompt: str | None = None
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    judge_template: str = JUDGE_TEMPLATE
    verdict_mode: str = "prefix"
    batch_size: int = 16
    judge_batch_size: int = 32
    judge_tail: int | None = None
    partitions: int | None = None
    ks: Sequence[int] = DEFAULT_KS
    strict: bool = False
    run_id: str | None = None
    call_store: str | None = None
    judge_name: str = ""


def load_samples(
    spark: SparkSession,
    data_dir: str,
    datasets: Sequence[str],
    split: str = "test",
    max_samples: int | None = None,
) -> DataFrame:
    """Normalised rows of all datasets, from one scan of their files."""
    return normalize_many(read_split(spark, data_dir, datasets, split, max_samples), datasets)


def with_chat(samples: DataFrame, system_prompt: str | None) -> DataFrame:
    return samples.withColumn("messages", chat_messages(F.col("problem"), system_prompt))


def with_run(df: DataFrame, run_id: str, model_path: str) -> DataFrame:
    return df.withColumns(
        {"run_id": F.lit(run_id), "model": short_name(F.lit(model_path))}
    )


def run_metrics(
    verdicts: DataFrame,
    ks: Sequence[int] = DEFAULT_KS,
    by: Sequence[str] = METRIC_KEYS,
    tokens: str = "tokens_used",
) -> DataFrame:
    """All metrics of every run, model and dataset in the table."""
    return comprehensive(metric_rows(verdicts, by, tokens=tokens), by, ks).withColumn(
        "evaluation_timestamp", iso_stamp(F.current_timestamp())
    )


def write_summary(
    metrics: DataFrame,
    path: str,
    ks: Sequence[int] = DEFAULT_KS,
    grouped: DataFrame | None = None,
) -> None:
    """Metrics documents, one JSON line per dataset, with the metrics of problem groups if given."""
    info = ("model", "model_path", "evaluation_timestamp")
    documents = metrics_documents(metrics, ks, [c for c in info if c in metrics.columns], grouped)
    save_jsonl(documents, path, mode="overwrite")


def run_benchmark(
    spark: SparkSession,
    settings: BenchmarkSettings,
    make_model: ModelFactory,
    make_judge: ModelFactory,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Runs all datasets as one job and returns the metrics rows.

    ``groups`` (``group_name, sample_id``) names groups of problems, whose metrics the summary gets.

    The lineage is cut by a written table after each stage: the raw files are read once,
    and model calls are expensive and need not repeat themselves. Unreadable records stay in
    the samples table with their ``error``. The run counts once all its tables are written; with
    ``call_store`` a run that broke off doesn't repeat the model calls it had made.
    """
    run_id = settings.run_id or new_run_id(spark, settings.model_path)
    out = settings.out_dir.rstrip("/")
    with run_commit(spark, out, run_id) as stages:
        return _run_stages(spark, settings, run_id, out, stages, make_model, make_judge, groups)


def _run_stages(
    spark: SparkSession,
    settings: BenchmarkSettings,
    run_id: str,
    out: str,
    stages: dict[str, str],
    make_model: ModelFactory,
    make_judge: ModelFactory,
    groups: DataFrame | None,
) -> DataFrame:
    """The stages of a run; each folder written is entered into ``stages``."""

    def write_stage(rows: DataFrame, name: str) -> DataFrame:
        write_run_table(rows, f"{out}/{name}", run_id)
        stages[name] = run_folder(f"{out}/{name}", run_id)
        return read_run_table(spark, f"{out}/{name}", run_id)

    register_run(spark, f"{out}/runs", run_id, settings.model_path, asdict(settings))
    samples = load_samples(
        spark, settings.data_dir, settings.datasets, settings.split, settings.max_samples
    )
    written_samples = write_stage(with_run(samples, run_id, settings.model_path), "samples")
    prompts = with_chat(good_samples(written_samples, settings.strict), settings.system_prompt)
    responses = generate(
        prompts,
        make_model,
        settings.generation,
        "messages",
        settings.batch_size,
        settings.partitions,
        settings.call_store and f"{settings.call_store.rstrip('/')}/generate",
        settings.model_path,
    ).drop("messages")
    verdicts = judge(
        write_stage(responses, "responses"),
        make_judge,
        settings.judge_template,
        settings.verdict_mode,
        batch_size=settings.judge_batch_size,
        tail=settings.judge_tail,
        partitions=settings.partitions,
        store=settings.call_store and f"{settings.call_store.rstrip('/')}/judge",
        judge_name=settings.judge_name,
    )
    results = write_stage(verdicts, "results")
    written = write_stage(run_metrics(results, settings.ks), "metrics")
    grouped = None
    if groups is not None:
        grouped = group_metrics(metric_rows(results, ("dataset",)), groups, ("dataset",))
    described = written.withColumn("model_path", F.lit(settings.model_path))
    write_summary(described, f"{out}/summary/run_id={run_id}", settings.ks, grouped)
    return written

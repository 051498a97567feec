"""Comparison of the runs of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from evalspark.operators.compare import (
    comparison_documents,
    comparison_grid,
    report_lines,
    with_title,
)
from evalspark.sinks.commits import committed_runs
from evalspark.sinks.tables import read_run_table, save_jsonl, write_text_lines
from evalspark.sources.folders import exists


def compare_runs(
    spark: SparkSession,
    metrics_path: str,
    runs: Sequence[str],
    models: Sequence[str],
    out_dir: str | None = None,
) -> DataFrame:
    """Grid of datasets and models over the named runs, one run per model.

    Where the folder above ``metrics_path`` has manifests of complete runs, other runs aren't taken.

    With ``out_dir`` the comparison documents and the markdown report are written too.
    """
    metrics = read_run_table(spark, metrics_path)
    base = metrics_path.rstrip("/").rsplit("/", 1)[0]
    chosen = list(runs)
    if exists(spark, f"{base}/commits"):
        complete = committed_runs(spark, base)
        chosen = [run for run in runs if run in complete]
    grid = comparison_grid(metrics.filter(metrics["run_id"].isin(*chosen)), models)
    if out_dir is not None:
        out = out_dir.rstrip("/")
        save_jsonl(comparison_documents(grid), f"{out}/model_comparison", mode="overwrite")
        write_text_lines(
            with_title(report_lines(grid)),
            ["dataset", "line_no", "model"],
            "line",
            f"{out}/comparison_report",
        )
    return grid

"""Models side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.reporting import percent, three_decimals

COMPARED = ("accuracy", "total_samples", "pass_at_1", "pass_at_3")


def comparison_grid(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row for every dataset and every named model, nulls where the model has no run.

    ``metrics`` has one row per dataset and model. Datasets are those of any model; the
    grid is an expansion of the dataset list by the given names, not a join.
    """
    names = F.array(*[F.lit(m) for m in models])
    cells = metrics.select("dataset").distinct().select("dataset", F.explode(names).alias("model"))
    return cells.join(metrics.select("dataset", "model", *COMPARED), ["dataset", "model"], "left")


def comparison_documents(grid: DataFrame) -> DataFrame:
    """``(dataset, model, document)``: the JSON cell of each model, ``null`` when missing."""
    cell = F.to_json(F.struct(*COMPARED))
    return grid.select(
        "dataset",
        "model",
        F.when(F.col("total_samples").isNull(), F.lit("null")).otherwise(cell).alias("document"),
    )


def wide_comparison(grid: DataFrame, models: Sequence[str], value: str = "accuracy") -> DataFrame:
    """One column per model."""
    return grid.groupBy("dataset").pivot("model", list(models)).agg(F.first(value))


def summary_lines(metrics: DataFrame) -> DataFrame:
    """``(dataset, line)``: one sentence per metrics row."""
    # The wording of the sentence.
    return metrics.select(
        "dataset",
        F.concat(
            "dataset",
            F.lit(" completed: "),
            percent(F.col("accuracy")),
            F.lit(" accuracy ("),
            F.col("total_samples"),
            F.lit(" samples)"),
        ).alias("line"),
    )


def report_lines(grid: DataFrame) -> DataFrame:
    """Markdown report as ``(dataset, line_no, model, line)``; order by the first three.

    Each dataset gets a heading and a table with one row per model, ``-`` where a model has
    no run. Lines stay rows, so no dataset is gathered into one value.
    """
    # Heading and table head of the report.
    head = [
        (0, F.concat(F.lit("## "), F.upper("dataset"))),
        (1, F.lit("")),
        (2, F.lit("| Model | Accuracy | Pass@1 | Pass@3 | Samples |")),
        (3, F.lit("|-------|----------|--------|--------|---------|")),
        (5, F.lit("")),
    ]
    heading = grid.select("dataset").distinct().select(
        "dataset",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("line_no"), F.lit("").alias("model"), text.alias("line"))
                    for n, text in head
                ]
            )
        ),
    )
    cells = [three_decimals(F.col(c)) for c in ("accuracy", "pass_at_1", "pass_at_3")]
    filled = F.concat_ws(" | ", F.col("model"), *cells, F.col("total_samples").cast("string"))
    empty = F.concat(F.col("model"), F.lit(" | - | - | - | -"))
    rows = grid.select(
        "dataset",
        F.lit(4).alias("line_no"),
        "model",
        F.concat(
            F.lit("| "),
            F.when(F.col("total_samples").isNull(), empty).otherwise(filled),
            F.lit(" |"),
        ).alias("line"),
    )
    return heading.unionByName(rows)


def with_title(lines: DataFrame) -> DataFrame:
    """Report lines below the title, which sorts before every dataset."""
    # The title of the report.
    title = [("", 0, "", "# Model Comparison Report"), ("", 1, "", "")]
    head = lines.sparkSession.createDataFrame(
        title, "dataset string, line_no int, model string, line string"
    )
    return head.unionByName(lines)

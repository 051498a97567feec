"""Checks of raw benchmark files and of normalised samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import json_values as J
from evalspark.operators.normalize import REGISTRY
from evalspark.sources.catalogue import expected_files
from evalspark.sources.jsonl import keep_first_lines

REQUIRED_FIELDS = ("problem", "answer")

# Messages fit one ordering: any unreadable line beats every field problem.
_UNREADABLE, _FIELD, _FINE = 0, 1, 2


def has_fields(record: Column, fields: Sequence[str] = REQUIRED_FIELDS) -> Column:
    """All fields exist, null or not."""
    present = F.lit(True)
    for name in fields:
        present = present & J.field(record, name).isNotNull()
    return present


def is_complete(record: Column, fields: Sequence[str] = ("question", "answer")) -> Column:
    """All fields exist and hold something."""
    full = F.lit(True)
    for name in fields:
        full = full & J.truthy(J.field(record, name))
    return full


def complete_samples(raw: DataFrame, fields: Sequence[str] = ("question", "answer")) -> DataFrame:
    return raw.filter(is_complete(J.record_of(F.col("value")), fields))


def raw_check(
    lines: DataFrame,
    by: Sequence[str] = ("dataset", "file"),
    max_lines: int | None = None,
) -> DataFrame:
    """``(*by, ok, message)`` per file; the first problem is reported.

    ``lines`` has ``line_idx``, ``rec_idx`` and ``value``. All are checked, or the first ``max_lines``.
    """
    record = F.col("_record")
    checked = keep_first_lines(lines, max_lines).withColumn("_record", J.record_of(F.col("value")))
    sample = F.col("rec_idx").cast("string")

    def missing(name: str) -> tuple[Column, Column]:
        text = F.concat(F.lit(f"Missing required field '{name}' in sample "), sample)
        return J.field(record, name).isNull(), text

    # The wording of the messages, here and below.
    problem_missing, problem_text = missing("problem")
    answer_missing, answer_text = missing("answer")
    empty = ~(J.truthy(J.field(record, "problem")) & J.truthy(J.field(record, "answer")))
    message = (
        F.when(record.isNull(), F.concat(F.lit("JSON decode error in line "), F.col("line_idx") + 1))
        .when(problem_missing, problem_text)
        .when(answer_missing, answer_text)
        .when(empty, F.concat(F.lit("Empty required field in sample "), sample))
    )
    level = F.when(record.isNull(), _UNREADABLE).when(F.col("_message").isNotNull(), _FIELD)
    rated = checked.withColumn("_message", message).withColumn("_level", level.otherwise(_FINE))
    worst = F.min(F.struct("_level", "line_idx", "_message"))
    per_file = rated.groupBy(*by).agg(worst.alias("_worst"), F.count(F.lit(1)).alias("_n"))
    ok = F.col("_worst._level") == _FINE
    return per_file.select(
        *by,
        ok.alias("ok"),
        F.when(
            ok, F.concat(F.lit("Valid JSONL with "), F.col("_n"), F.lit(" samples checked"))
        )
        .otherwise(F.col("_worst._message"))
        .alias("message"),
    )


def add_empty_files(checks: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files without any record fail too."""
    return files.select(*by).join(checks, list(by), "left").select(
        *by,
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("message", F.lit("No valid JSON objects found")).alias("message"),
    )


def loader_check(normalized: DataFrame, datasets: DataFrame) -> DataFrame:
    """``(dataset, ok, message)``: known, readable and not empty after normalisation."""
    per_dataset = normalized.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("error").alias("_error"),
    )
    known = F.col("dataset").isin(*sorted(REGISTRY))
    checked = datasets.select("dataset").distinct().join(per_dataset, "dataset", "left")
    message = (
        F.when(~known, F.concat(F.lit("Unknown dataset: "), F.col("dataset")))
        .when(F.col("_error").isNotNull(), F.concat(F.lit("Loader error: "), F.col("_error")))
        .when(F.coalesce("_n", F.lit(0)) == 0, F.lit("No samples loaded"))
    )
    return checked.select(
        "dataset",
        message.isNull().alias("ok"),
        F.coalesce(
            message,
            F.concat(
                F.lit("Successfully loaded "),
                F.col("_n"),
                F.lit(" samples using "),
                F.col("dataset"),
                F.lit(" loader"),
            ),
        ).alias("message"),
    )


def file_verdict(file_checks: DataFrame) -> DataFrame:
    """``(dataset, file_ok)``: the light check, any valid file makes the dataset valid."""
    return file_checks.groupBy("dataset").agg(F.bool_or("ok").alias("file_ok"))


def dataset_verdict(file_checks: DataFrame, loader_checks: DataFrame) -> DataFrame:
    """``(dataset, file_ok, loader_ok, valid)``: any valid file and a readable dataset."""
    return (
        loader_checks.select("dataset", F.col("ok").alias("loader_ok"))
        .join(file_verdict(file_checks), "dataset", "left")
        .select(
            "dataset",
            F.coalesce("file_ok", F.lit(False)).alias("file_ok"),
            "loader_ok",
            (F.coalesce("file_ok", F.lit(False)) & F.col("loader_ok")).alias("valid"),
        )
    )


def validation_totals(verdicts: DataFrame, valid: str = "valid") -> DataFrame:
    return verdicts.agg(
        F.count_if(valid).alias("valid_datasets"), F.count(F.lit(1)).alias("datasets")
    )


def expected_file_check(inventory: DataFrame, datasets: DataFrame) -> DataFrame:
    """``(dataset, has_test_file)``: at least one of the expected files exists."""
    spark = inventory.sparkSession
    found = (
        expected_files(spark, datasets.select("dataset").distinct())
        .join(inventory.select("dataset", "file"), ["dataset", "file"], "left_semi")
        .select("dataset")
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    return datasets.select("dataset").distinct().join(found, "dataset", "left").select(
        "dataset", F.coalesce("_found", F.lit(False)).alias("has_test_file")
    )


def requested_datasets(requested: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested names that exist, and those that do not."""
    asked = requested.select("dataset").distinct()
    return (
        asked.join(available, "dataset", "left_semi"),
        asked.join(available, "dataset", "left_anti"),
    )

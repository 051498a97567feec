"""Validation of a folder of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.normalize import REGISTRY, normalize_many
from evalspark.operators.quality import (
    add_empty_files,
    dataset_verdict,
    file_verdict,
    loader_check,
    raw_check,
    requested_datasets,
)
from evalspark.sources.catalogue import available_datasets, expected_files, file_inventory
from evalspark.sources.jsonl import read_jsonl


def _names(df: DataFrame) -> list[str]:
    """Dataset folder names; a data folder holds a handful."""
    return sorted(r[0] for r in df.select("dataset").collect())


def _file_checks(
    spark: SparkSession, data_dir: str, present: DataFrame, max_samples: int
) -> DataFrame:
    """``(dataset, file, ok, message)`` for the test files that exist."""
    paths = [
        f"{data_dir.rstrip('/')}/{r.dataset}/{r.file}"
        for r in present.select("dataset", "file").collect()
    ]
    if not paths:
        return present.select(
            "dataset", "file", F.lit(False).alias("ok"), F.lit("").alias("message")
        )
    lines = read_jsonl(spark, paths, max_samples).withColumn(
        "file", F.regexp_extract("file", r"/([^/]+\.jsonl?)(?:/[^/]*)?$", 1)
    )
    checks = raw_check(lines, ("dataset", "file"), max_samples)
    return add_empty_files(checks, present, ("dataset", "file"))


def _select(
    spark: SparkSession, inventory: DataFrame, requested: Sequence[str] | None
) -> tuple[DataFrame, DataFrame]:
    available = available_datasets(inventory)
    if requested is None:
        return available, available.limit(0)
    asked = spark.createDataFrame([(name,) for name in requested], "dataset string")
    return requested_datasets(asked, available)


def validate(
    spark: SparkSession,
    data_dir: str,
    requested: Sequence[str] | None = None,
    max_samples: int | None = None,
) -> dict[str, DataFrame]:
    """Tables ``files``, ``loader``, ``datasets`` (the verdicts) and ``missing``."""
    inventory = file_inventory(spark, data_dir)
    selected, missing = _select(spark, inventory, requested)
    test_files = expected_files(spark, selected).join(
        inventory.select("dataset", "file"), ["dataset", "file"], "left_semi"
    )
    checks = _file_checks(spark, data_dir, test_files, max_samples)
    readable = test_files.filter(F.col("file") == "test.jsonl")
    names = [name for name in _names(readable) if name in REGISTRY]
    if names:
        paths = [f"{data_dir.rstrip('/')}/{name}/test.jsonl" for name in names]
        samples = normalize_many(read_jsonl(spark, paths, max_samples), names)
    else:
        samples = selected.select("dataset", F.lit("").alias("error")).limit(0)
    loader = loader_check(samples, selected)
    return {
        "files": checks,
        "loader": loader,
        "datasets": dataset_verdict(checks, loader),
        "missing": missing,
    }


def simple_validate(
    spark: SparkSession, data_dir: str, max_samples: int | None = None
) -> DataFrame:
    """``(dataset, valid)`` from the raw files alone; no test file means not valid."""
    inventory = file_inventory(spark, data_dir)
    selected = available_datasets(inventory)
    # this check does not read test.json or the last of the AIME files
    test_files = (
        expected_files(spark, selected)
        .filter(~F.col("file").isin("test.json", "test2025-II.jsonl"))
        .join(inventory.select("dataset", "file"), ["dataset", "file"], "left_semi")
    )
    verdict = file_verdict(_file_checks(spark, data_dir, test_files, max_samples))
    return selected.join(verdict, "dataset", "left").select(
        "dataset", F.coalesce("file_ok", F.lit(False)).alias("valid")
    )

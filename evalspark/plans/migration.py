"""Conversion of raw benchmark files to one normalised Parquet table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evalspark.operators.normalize import REGISTRY, good_samples, normalize_many
from evalspark.operators.quality import expected_file_check, requested_datasets
from evalspark.sources.catalogue import available_datasets, file_inventory
from evalspark.sources.jsonl import read_jsonl

TABLE_KEYS = ("dataset", "split")


def _existing_datasets(spark: SparkSession, target: str) -> set[str]:
    try:
        table = spark.read.parquet(target)
    except AnalysisException:
        return set()
    return {r[0] for r in table.select(F.col("dataset").cast("string")).distinct().collect()}


def _remove(spark: SparkSession, folders: Sequence[str]) -> None:
    """Removes folders of a table, so that splits gone from the source go too."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def migrate(
    spark: SparkSession,
    source_dir: str,
    target: str,
    requested: Sequence[str] | None = None,
    overwrite: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """Writes each dataset's splits to ``target``; returns ``(dataset, status, rows, unreadable)``.

    The table holds unreadable records too, with their ``error``; ``migrated_samples`` reads
    the others. A dataset already in the target is left alone unless ``overwrite``;
    ``dry_run`` only counts. Status is migrated, would migrate, exists, unsupported or missing.
    """
    inventory = file_inventory(spark, source_dir)
    available = available_datasets(inventory)
    if requested is None:
        chosen, missing = available, available.limit(0)
    else:
        asked = spark.createDataFrame([(name,) for name in requested], "dataset string")
        chosen, missing = requested_datasets(asked, available)

    # folder names: a data folder holds a handful
    names = sorted(r[0] for r in chosen.collect())
    absent = sorted(r[0] for r in missing.collect())
    existing = set() if overwrite else _existing_datasets(spark, target)
    todo = [n for n in names if n in REGISTRY and n not in existing]

    status = [(n, "missing") for n in absent]
    status += [(n, "unsupported") for n in names if n not in REGISTRY]
    status += [(n, "exists") for n in names if n in REGISTRY and n in existing]
    skipped = spark.createDataFrame(status, "dataset string, status string").withColumns(
        {"rows": F.lit(None).cast("bigint"), "unreadable": F.lit(None).cast("bigint")}
    )
    if not todo:
        return skipped

    lines = read_jsonl(spark, [f"{source_dir.rstrip('/')}/{name}/*.jsonl" for name in todo])
    samples = normalize_many(lines, todo)
    if not dry_run:
        if overwrite:
            _remove(spark, [f"{target.rstrip('/')}/dataset={name}" for name in todo])
        (
            samples.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*TABLE_KEYS)
            .parquet(target)
        )
        samples = spark.read.parquet(target).filter(F.col("dataset").isin(*todo))
    counts = samples.groupBy("dataset").agg(
        F.count_if(F.col("error").isNull()).alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("unreadable"),
    )
    done = counts.select(
        "dataset",
        F.lit("would migrate" if dry_run else "migrated").alias("status"),
        "rows",
        "unreadable",
    )
    return done.unionByName(skipped)


def migrated_samples(spark: SparkSession, target: str, strict: bool = False) -> DataFrame:
    return good_samples(spark.read.parquet(target), strict)


def check_migrated(spark: SparkSession, source_dir: str) -> DataFrame:
    """``(dataset, has_test_file)`` of a folder of raw datasets."""
    inventory = file_inventory(spark, source_dir)
    return expected_file_check(inventory, available_datasets(inventory))

"""Which datasets, splits and files a data folder holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.reporting import size_kb

# The splits each known dataset declares.
DECLARED_SPLITS = {
    "math": ("test", "train"),
    "gsm8k": ("test", "train"),
    "aime": ("test",),
    "aime25": ("test",),
    "olympiadbench": ("test",),
    "mmlu-pro": ("test", "validation"),
    "amc": ("test",),
    "gpqa": ("test",),
    "minerva": ("test",),
}

# Files that may hold a test split; the last set is read for one dataset only.
TEST_FILES = ("test.jsonl", "test.json")
AIME_TEST_FILES = ("test2024.jsonl", "test2025-I.jsonl", "test2025-II.jsonl")


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Names in a folder, and whether each is a folder itself; hidden ones are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    named = [(status.getPath().getName(), status.isDirectory()) for status in found]
    return [(name, is_folder) for name, is_folder in named if name[0] not in "._"]


def _listed(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(dataset, file)`` of the folders, which are a handful; an empty folder has a null file."""
    rows: list[tuple[str, str | None]] = []
    for dataset, is_folder in _entries(spark, data_dir):
        if is_folder:
            names = [name for name, _ in _entries(spark, f"{data_dir.rstrip('/')}/{dataset}")]
            rows += [(dataset, name) for name in names or [None]]
    return spark.createDataFrame(rows, "dataset string, file string")


def file_inventory(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(dataset, file, bytes, size)`` per file; part files count to their folder.

    Only path and length are read, never the content. Empty files have 0 bytes; a dataset
    folder without files has one row with a null file.
    """
    root = re.escape(data_dir.rstrip("/"))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(data_dir)
        .select(
            F.regexp_extract("path", root + r"/([^/]+)/([^/]+)", 1).alias("dataset"),
            F.regexp_extract("path", root + r"/([^/]+)/([^/]+)", 2).alias("file"),
            "length",
        )
        .filter(F.col("dataset") != "")
    )
    # Spark plans no task for an empty file, so the names come from the listing
    lengths = files.groupBy("dataset", "file").agg(F.sum("length").alias("bytes"))
    return (
        _listed(spark, data_dir)
        .join(lengths, ["dataset", "file"], "left")
        .withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint")))
        .withColumn("size", size_kb(F.col("bytes")))
    )


def dataset_totals(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy("dataset")
        .agg(F.count("file").alias("n_files"), F.sum("bytes").alias("bytes"))
        .withColumn("size", size_kb(F.col("bytes")))
    )


def available_datasets(inventory: DataFrame) -> DataFrame:
    return inventory.select("dataset").distinct()


def split_catalogue(spark: SparkSession, inventory: DataFrame) -> DataFrame:
    """``(dataset, split, declared, found)`` for every declared or present split."""
    declared = spark.createDataFrame(
        [(name, split) for name, splits in DECLARED_SPLITS.items() for split in splits],
        "dataset string, split string",
    ).withColumn("declared", F.lit(True))
    found = (
        inventory.filter(F.col("file").rlike(r"\.jsonl$"))
        .select("dataset", F.regexp_replace("file", r"\.jsonl$", "").alias("split"))
        .withColumn("found", F.lit(True))
    )
    return declared.join(found, ["dataset", "split"], "full").select(
        "dataset",
        "split",
        F.coalesce("declared", F.lit(False)).alias("declared"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def expected_files(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    """``(dataset, file)`` pairs of which each dataset needs at least one."""
    common = datasets.select("dataset", F.explode(F.array(*map(F.lit, TEST_FILES))).alias("file"))
    extra = datasets.filter(F.col("dataset") == "aime").select(
        "dataset", F.explode(F.array(*map(F.lit, AIME_TEST_FILES))).alias("file")
    )
    return common.unionByName(extra)

"""Line files with stable line numbers, read without shuffling the text.

A *source* is one ``{split}.jsonl``, either a single file or a folder of part files whose
names give their order. Every line gets two numbers within its source:

* ``line_idx`` counts physical lines, blank ones included (limits use it);
* ``rec_idx`` counts non-blank lines (record ids use it).

Blank lines are dropped after counting, blanks around a record are stripped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import is_blank, strip
from evalspark.operators.sizes import MAX_BROADCAST_ROWS
from evalspark.sources.blocks import list_files
from evalspark.sources.folders import exists
from evalspark.sources.line_blocks import first_lines

SOURCE_PATTERN = r"^(.*?/[^/]+\.jsonl?)(?:/[^/]*)?$"
DATASET_PATTERN = r"/([^/]+)/([^/]+)\.jsonl?(?:/[^/]*)?$"


def _scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_line_seq"),
    )


def _block_table(lines: DataFrame) -> DataFrame:
    """One row per file block with the numbers its first line and record get."""
    blocks = lines.groupBy("_part", "_file", "_block").agg(
        F.min("_line_seq").alias("_first_line"),
        F.count(F.lit(1)).alias("_n_lines"),
        F.count_if(~is_blank(F.col("value"))).alias("_n_records"),
    )
    blocks = blocks.withColumn("_source", F.regexp_extract("_file", SOURCE_PATTERN, 1))
    earlier = (Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("_source").orderBy("_file", "_block").rowsBetween(*earlier)
    in_part = Window.partitionBy("_part").orderBy("_first_line").rowsBetween(*earlier)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    return blocks.select(
        "_part",
        "_file",
        "_block",
        "_first_line",
        "_n_lines",
        "_n_records",
        before("_n_lines", in_source).alias("_lines_before"),
        before("_n_records", in_source).alias("_records_before"),
        # monotonically_increasing_id starts at the partition number shifted by 33 bits
        (
            F.shiftleft(F.col("_part").cast("bigint"), 33) + before("_n_records", in_part)
        ).alias("_first_record"),
    )


def number_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turn the per-partition counters into positions within the source.

    Both inputs come from the same scan. If the files were split differently for the two
    reads, no block fits and the query fails instead of numbering wrongly.
    """
    records = lines.filter(~is_blank(F.col("value"))).withColumn(
        "_rec_seq", F.monotonically_increasing_id()
    )
    joined = records.join(blocks, ["_part", "_file", "_block"], "left")
    line_in_block = F.col("_line_seq") - F.col("_first_line")
    record_in_block = F.col("_rec_seq") - F.col("_first_record")
    fits = line_in_block.between(0, F.col("_n_lines") - 1) & record_in_block.between(
        0, F.col("_n_records") - 1
    )
    changed = F.raise_error(F.lit("the files were split differently between two reads"))

    def checked(index: Column) -> Column:
        return F.when(fits, index).otherwise(changed.cast("bigint"))

    return joined.select(
        F.regexp_extract("_file", DATASET_PATTERN, 1).alias("dataset"),
        F.regexp_extract("_file", DATASET_PATTERN, 2).alias("split"),
        F.col("_file").alias("file"),
        checked(F.col("_lines_before") + line_in_block).alias("line_idx"),
        checked(F.col("_records_before") + record_in_block).alias("rec_idx"),
        strip(F.col("value")).alias("value"),
    )


def _block_bound(lines: DataFrame) -> int:
    """Upper bound of the number of blocks: every block but a file's last fills a partition."""
    return len(lines.inputFiles()) + lines.rdd.getNumPartitions()


def keep_first_lines(lines: DataFrame, max_lines: int | None) -> DataFrame:
    """First physical lines of each source; 0 or None keeps all, a negative limit none."""
    if not max_lines:
        return lines
    return lines.filter(F.col("line_idx") < F.lit(max(max_lines, 0)))


def _kept_blocks(spark: SparkSession, lines: DataFrame, paths: Sequence[str], index_dir: str) -> DataFrame:
    """The block table as an earlier read of the same files, split alike, has left it, else computed and kept.

    Files are the same while name, length and time of change are.
    """
    files = sorted(f for path in paths for f in list_files(spark, path))
    described = repr((files, lines.rdd.getNumPartitions(), lines.schema.names))
    path = f"{index_dir.rstrip('/')}/{hashlib.sha256(described.encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        _block_table(lines).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], max_lines: int | None = None, index_dir: str | None = None
) -> DataFrame:
    """``(dataset, split, file, line_idx, rec_idx, value)`` of all non-blank lines.

    Two scans of the text and one join with a row per file block. The block table is
    broadcast while its bound is small; beyond that the join shuffles by block, which no
    file can skew because a block is at most ``spark.sql.files.maxPartitionBytes``. With ``index_dir`` the
    block table is kept there, and later reads of unchanged files scan the text once.

    With ``max_lines`` above 0 only a prefix of each source is read (see ``first_lines``).
    """
    named = [paths] if isinstance(paths, str) else list(paths)
    lines = _scan(spark, named)
    if max_lines is not None and max_lines > 0:
        files = [file for path in named for file in list_files(spark, path)]
        return first_lines(spark, files, SOURCE_PATTERN, max_lines).select(
            F.regexp_extract("file", DATASET_PATTERN, 1).alias("dataset"),
            F.regexp_extract("file", DATASET_PATTERN, 2).alias("split"),
            "file",
            "line_idx",
            "rec_idx",
            "value",
        )
    blocks = _block_table(lines) if index_dir is None else _kept_blocks(spark, lines, named, index_dir)
    if _block_bound(lines) <= MAX_BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    return keep_first_lines(number_lines(lines, blocks), max_lines)


def split_path(data_dir: str, dataset: str, split: str = "test") -> str:
    return f"{data_dir.rstrip('/')}/{dataset}/{split}.jsonl"


def read_split(
    spark: SparkSession,
    data_dir: str,
    datasets: str | Sequence[str],
    split: str = "test",
    max_samples: int | None = None,
    index_dir: str | None = None,
) -> DataFrame:
    """One split of one or many datasets under ``{data_dir}/{dataset}/{split}.jsonl``.

    ``max_samples`` limits the physical lines of each dataset.
    """
    names = [datasets] if isinstance(datasets, str) else list(datasets)
    paths = [split_path(data_dir, name, split) for name in names]
    return read_jsonl(spark, paths, max_samples, index_dir)

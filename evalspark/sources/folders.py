"""What is in a folder, asked of its file system on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    return pattern, pattern.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches a path or pattern."""
    pattern, files = _opened(spark, path)
    found = files.globStatus(pattern)
    return found is not None and len(found) > 0


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a table's first partition column, from the names of its folders; none if the path is missing."""
    pattern, files = _opened(spark, f"{path.rstrip('/')}/{column}=*")
    return [status.getPath().getName().split("=", 1)[1] for status in files.globStatus(pattern) or []]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder with all it holds, if it is there."""
    place, files = _opened(spark, path)
    files.delete(place, True)

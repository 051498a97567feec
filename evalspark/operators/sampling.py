"""Seeded sampling that gives the same rows on every run and every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The last rows of a sample are sorted when no more than this many share their digest prefix.
HEAP_LIMIT = 10_000

# Hex digits of the digest by which one round narrows the boundary: 4096 counts.
ROUND_DIGITS = 3


def sample_key(keys: Sequence[str], seed: int) -> Column:
    """Pseudo-random order of rows: a digest of the seed and the row key."""
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _boundary(keyed: DataFrame, n: int) -> tuple[str, int] | None:
    """Digest prefix that holds the n-th row, and how many of its rows are wanted.

    Each round counts the rows by the next digits, partially in every task, and reads back
    at most 4096 counts. None when there are no more than n rows.
    """
    prefix, wanted = "", n
    while True:
        digits = F.substring("_order", len(prefix) + 1, ROUND_DIGITS)
        counts = (
            keyed.filter(F.startswith("_order", F.lit(prefix)))
            .groupBy(digits.alias("digits"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        if not prefix and sum(r["n"] for r in counts) <= n:
            return None
        for row in sorted(counts, key=lambda r: r["digits"]):
            if row["n"] >= wanted:
                break
            wanted -= row["n"]
        prefix += row["digits"]
        if row["n"] <= HEAP_LIMIT:
            return prefix, wanted
        if not row["digits"]:
            raise ValueError("the keys must identify a row")


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, all rows if there are fewer.

    ``keys`` must identify a row. Counts find the digest prefix at which the sample ends, and a
    filter takes the rows below it, so no task holds the sample and nothing is shuffled but the
    few rows that share the prefix.
    """
    if n <= 0:
        return df.limit(0)
    keyed = df.withColumn("_order", sample_key(keys, seed))
    boundary = _boundary(keyed, n)
    if boundary is None:
        return df
    prefix, wanted = boundary
    start = F.left("_order", F.lit(len(prefix)))
    below = keyed.filter(start < prefix)
    at = keyed.filter(start == prefix).orderBy("_order", *keys).limit(wanted)
    return below.unionByName(at).drop("_order")

"""Exact percentiles with linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ranks import values_at_ranks

DEFAULT_PERCENTS = (25, 50, 75, 90, 95)


def percentiles(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    percents: Sequence[int] = DEFAULT_PERCENTS,
) -> DataFrame:
    """One row per group with a column ``p{percent}`` each; 0.0 for an ungrouped empty input.

    The position of a percentile is ``p / 100 * (n - 1)``; between two rows it is
    interpolated linearly. The wanted ranks are searched in range partitions, so no task
    holds a group.
    """
    return _searched(df.filter(F.col(value).isNotNull()), value, by, percents)


def _columns(table: DataFrame, by: Sequence[str], percents: Sequence[int]) -> DataFrame:
    return table.select(
        *by,
        *[
            F.coalesce(F.get("_at", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"p{p}")
            for i, p in enumerate(percents)
        ],
    )


def _searched(
    df: DataFrame, value: str, by: Sequence[str], percents: Sequence[int]
) -> DataFrame:
    positions = [F.lit(p / 100) * (F.col("n") - 1) for p in percents]
    low = [F.floor(position).cast("bigint") for position in positions]
    high = [F.least(rank + 1, F.col("n") - 1) for rank in low]
    found = values_at_ranks(df, by, value, [*low, *high])
    # at most two rows per percentile reach a group
    table = found.groupBy(*by).agg(
        F.map_from_entries(
            F.collect_list(F.struct("rank", F.col("value").cast("double")))
        ).alias("_values"),
        F.max("n").alias("n"),
    )
    below = [F.try_element_at("_values", rank) for rank in low]
    above = [F.try_element_at("_values", rank) for rank in high]
    at = [
        b + (a - b) * (position - rank)
        for b, a, position, rank in zip(below, above, positions, low, strict=True)
    ]
    return _columns(table.withColumn("_at", F.array(*at)), by, percents)


def approximate_percentiles(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    percents: Sequence[int] = DEFAULT_PERCENTS,
    accuracy: int = 10_000,
) -> DataFrame:
    """Sketch-based variant in one aggregation, for a dashboard that needs no exact value."""
    table = df.groupBy(*by).agg(
        F.approx_percentile(
            value, F.array(*[F.lit(p / 100) for p in percents]), F.lit(accuracy)
        ).alias("_at")
    )
    return _columns(table, by, percents)

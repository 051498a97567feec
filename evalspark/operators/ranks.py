"""Exact values at given ranks of each group, without one task per group.

Spark's ``percentile`` keeps all distinct values of a group in one task. Here the distinct
values are range-partitioned over all groups, so a group that holds most of the rows is
spread like the rest; only the range cells that contain a wanted rank are then ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.sizes import broadcast_if_small
from evalspark.session import scratch_path


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null group matches itself."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, condition).drop(*[f"_right_{k}" for k in keys])


def values_at_ranks(
    df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[Column]
) -> DataFrame:
    """``(*by, n, rank, value)`` for each wanted zero-based rank.

    ``ranks`` are bigint expressions of the column ``n``, the group's row count; nulls in
    ``value`` are not counted.
    """
    spark = df.sparkSession
    by = list(by)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    # Two branches read the cell numbers, so they are pinned in a written table.
    path = scratch_path(spark, "ranks")
    counted.repartitionByRange(*by, "_v").withColumn(
        "_cell", F.spark_partition_id()
    ).write.parquet(path)
    cells_of_rows = spark.read.parquet(path)

    names = [f"_rank{i}" for i in range(len(ranks))]
    in_group = Window.partitionBy(*by)
    running = in_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells_of_rows.groupBy(*by, "_cell").agg(F.sum("_cnt").alias("_rows"))
    cells = (
        cells.withColumn("n", F.sum("_rows").over(in_group))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .withColumns(dict(zip(names, ranks, strict=True)))
        .filter(_any_between(names, F.col("_start"), F.col("_start") + F.col("_rows")))
        .drop("_rows")
    )
    # at most two cells per wanted rank pair and group, but groups may be many
    cells = broadcast_if_small(cells)
    upto = (
        Window.partitionBy(*by, "_cell")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # only the values of the chosen cells are sorted; their ranks join again afterwards
    in_cell = (
        join_null_safe(cells_of_rows, cells.select(*by, "_cell"), [*by, "_cell"])
        .withColumn("_upto", F.sum("_cnt").over(upto))
    )
    end = F.col("_start") + F.col("_upto")
    hits = join_null_safe(in_cell, cells, [*by, "_cell"]).filter(
        _any_between(names, end - F.col("_cnt"), end)
    )
    wanted = F.filter(
        F.array_distinct(F.array(*names)), lambda r: (r >= end - F.col("_cnt")) & (r < end)
    )
    return hits.select(*by, "n", F.explode(wanted).alias("rank"), F.col("_v").alias("value"))


def _any_between(names: Sequence[str], start: Column, end: Column) -> Column:
    """At least one of the columns lies in [start, end)."""
    return reduce(lambda a, b: a | b, [(F.col(c) >= start) & (F.col(c) < end) for c in names])

"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import saved
from evalspark.session import scratch_path


def _hung(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hangs the neighbours of every node (and itself) on the least of them.

    Both ways, only the larger neighbours move (large star); else the smaller ones do (small star).
    The least is found with a partial step in each task, so a hub with many links is no hot group.
    """
    pairs = links.select("a", "b")
    if both_ways:
        pairs = pairs.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = pairs.where("b > a" if both_ways else "b <= a").join(least, "a")
    rows = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both_ways:
        rows = rows.unionByName(least.select("a", F.col("m").alias("b")))
    return rows.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that a link (``a``, ``b``) names.

    Links of a node with itself name it, too. No links give no rows.
    """
    spark = links.sparkSession
    names = saved(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        scratch_path(spark, "links"),
    )
    stars = names.where("a <> b")
    state = _state(stars)
    while state[0]:
        stars = saved(_hung(_hung(stars, True), False), scratch_path(spark, "stars"))
        if state == (state := _state(stars)):
            break
    nodes = names.select(F.col("a").alias("node")).union(names.select("b")).distinct()
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )

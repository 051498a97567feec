"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources get targets in words by their weights. Within a source a document's expected number of copies
rises with its size (its size class to the power ``tilt``), scaled so that the expected words meet
the target. Whole copies are certain; the remainder is the inclusion probability of one more. Documents
are ranked by the odds of their random number over their inclusion odds, and the first ones whose words
fill the rest of the target are taken. The place where the ranking is cut is found by counting words in
ever finer ranges of ranks, so no source is sorted or gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import saved
from evalspark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGES = 1 << 12
HASH_DIGITS = 13


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key; null has its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    number = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")
    return (number + 0.5) / float(16**HASH_DIGITS)


def size_weight(size: Column, tilt: float) -> Column:
    """Weight of a document: the power of two above its size, to the power ``tilt``."""
    return F.pow(F.lit(2.0), F.length(F.bin(size)) * tilt)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source``, ``source_size`` with the target of each: one row per source.

    Sources in code point order (null last) take the weights in turn. All share ``share`` of all
    sizes by weight; no target exceeds ``cap`` times its source's size, and what is left over goes to
    the others by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    ).withColumn("most", F.col("source_size") * cap)
    # the sources that reach their limit are those of least limit for their weight
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    leveled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    water = F.max(fits).over(everywhere)
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("most"), F.coalesce(water * F.col("weight"), F.col("most"))).alias("target"),
    )


def _joined(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    named = other.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _rates(classes: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """By source: the rate that a weight is multiplied with, and the words left after whole copies."""
    rows = _joined(classes, goals)
    down = Window.partitionBy("source").orderBy(F.col("weight").desc())
    above = F.coalesce(
        F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    onward = F.sum(F.col("weight") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.when(onward > 0, (F.col("target") - above * cap) / onward)
    tried = rows.withColumn("rate", rate)
    fits = F.when(F.col("rate") * F.col("weight") <= cap * (1 + 1e-12), F.col("rate"))
    rated = tried.withColumn(
        "rate", F.coalesce(F.max(fits).over(Window.partitionBy("source")), F.lit(0.0))
    )
    whole = F.floor(F.least(F.lit(cap), F.col("rate") * F.col("weight")))
    return rated.groupBy("source", "source_size", "target", "rate").agg(
        (F.first("target") - F.sum(whole * F.col("words"))).alias("rest")
    )


def _expected(rate: Column, weight: Column, cap: float) -> Column:
    return F.least(F.lit(cap), rate * weight)


def _place(rate: Column, weight: Column, cap: float, chance: Column) -> Column:
    """Place in the Pareto order, in [0, 1): odds q as q / (1 + q); null where no copy is open."""
    open_ = _expected(rate, weight, cap) - F.floor(_expected(rate, weight, cap))
    q = chance / (1 - chance) / (open_ / (1 - open_))
    return F.when(open_ > 0, q / (1 + q))


def _narrowed(placed: DataFrame, cuts: DataFrame, wide: float) -> DataFrame:
    """The part, 1 / ``RANGES`` as wide, of each source's range in which its rest is used up.

    ``cuts`` has ``low``, where the range begins, and ``rest``, the words still open there.
    """
    width = wide / RANGES
    ranged = (
        _joined(placed, cuts)
        .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + wide))
        .withColumn("range", F.floor((F.col("place") - F.col("low")) / width))
    )
    sums = ranged.groupBy("source", "range", "low", "rest").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    first = F.min(F.struct("range", "low", "through", "words", "rest"))
    return (
        sums.withColumn("through", through)
        .where(F.col("through") >= F.col("rest"))
        .groupBy("source")
        .agg(first.alias("c"))
        .select(
            "source",
            (F.col("c.low") + F.col("c.range") * width).alias("low"),
            (F.col("c.rest") - (F.col("c.through") - F.col("c.words"))).alias("rest"),
        )
    )


def plan_mix(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """By source: source_size, target, rate, and where its order is cut.

    ``sized`` has source, size, weight and chance of every document. One more copy goes to the places
    below ``low`` and to those up to ``cut``, if that isn't null.
    """
    spark = sized.sparkSession
    classes = saved(
        sized.groupBy("source", "weight").agg(F.sum("size").alias("words")),
        scratch_path(spark, "mix-classes"),
    )
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    rates = saved(
        _rates(classes, targets(sizes, weights, share, cap), cap), scratch_path(spark, "mix-rates")
    )
    place = _place(F.col("rate"), F.col("weight"), cap, F.col("chance"))
    placed = (
        _joined(sized, rates.select("source", "rate"))
        .select("source", "size", place.alias("place"))
        .where(F.col("place").isNotNull() & (F.col("size") > 0))
    )
    cuts = rates.where("rest > 0").select("source", F.lit(0.0).alias("low"), "rest")
    wide = 1.0
    for _ in range(2):
        cuts = saved(_narrowed(placed, cuts, wide), scratch_path(spark, "mix-cuts"))
        wide /= RANGES
    through = F.sum("size").over(Window.partitionBy("source").orderBy("place"))
    miss = F.abs(F.col("through") - F.col("rest"))
    last = (
        _joined(placed, cuts)
        .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + wide))
        .withColumn("through", through)
        .groupBy("source", "low", "rest")
        .agg(F.min(F.struct(miss.alias("miss"), "place")).alias("c"))
        # taking none of them misses by the whole rest
        .select("source", "low", F.when(F.col("c.miss") < F.col("rest"), F.col("c.place")).alias("cut"))
    )
    # a rest that all open copies together don't reach takes them all
    every = F.when(F.col("rest") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return saved(
        _joined(rates, last, "left").select(
            "source", "source_size", "target", "rate", F.coalesce("low", every).alias("low"), "cut"
        ),
        scratch_path(spark, "mix-plan"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    tilt: float = 0.25,
    seed: int = 7,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` words.

    ``copies`` is how often the mix takes the row, at most ``cap`` rounded up; 0 rows stay in the result.
    The added columns take the place of columns of these names; ``size`` can be another expression than
    the number of words. A null text has no words, and so has a text of blanks; such a document takes part
    with the least weight and adds nothing. A null source is a source of its own, the last. A document's
    random number comes from its doc_id and ``seed``, so reruns agree; rows with equal doc_id and equal size are taken or left
    together. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    sizes = words_in(F.col("text")) if size is None else size
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("source").alias("source"),
        sizes.alias("size"),
        uniform(F.col("doc_id"), seed).alias("chance"),
    ).withColumn("weight", size_weight(F.col("size"), tilt))
    narrow = saved(
        rows.select("source", "size", "chance", "weight"), scratch_path(spark, "mix-sizes")
    )
    plan = plan_mix(narrow, weights, share, cap)
    place = _place(F.col("rate"), F.col("weight"), cap, F.col("chance"))
    more = F.coalesce(place < F.col("low"), F.lit(False)) | F.coalesce(
        place <= F.col("cut"), F.lit(False)
    )
    whole = F.floor(_expected(F.col("rate"), F.col("weight"), cap))
    mixed = _joined(rows, plan).withColumn("copies", whole + more.cast("bigint"))
    added = ("size", "source_size", "target", "copies", "taken")
    return mixed.select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in added],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies``."""
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.withColumn("_times", F.explode(times)).drop("_times")

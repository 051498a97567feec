"""Metrics of verdict tables.

A verdict row has ``sample_id``, ``is_correct`` and, where known, ``tokens_used`` and
``confidence``; ``by`` names the grouping columns, such as run, model and dataset. All
metrics are filtered aggregates with map-side partial sums, so a group that holds most of
the rows reaches its reducer as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scoring import pass_at_k, ratio, token_efficiency
from evalspark.functions.verdicts import is_valid, verdict_label

DEFAULT_KS = (1, 3, 5)


def metric_rows(
    verdicts: DataFrame,
    by: Sequence[str] = ("dataset",),
    sample_id: str = "id",
    tokens: str = "tokens_used",
    confidence: str = "evaluation_confidence",
) -> DataFrame:
    """The columns the metrics read. ``tokens`` names the generator's or the judge's count."""
    have = set(verdicts.columns)
    return verdicts.select(
        *by,
        F.col(sample_id).alias("sample_id"),
        F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
        (F.coalesce(tokens, F.lit(0)) if tokens.split(".")[0] in have else F.lit(0))
        .cast("bigint")
        .alias("tokens_used"),
        (F.col(confidence) if confidence in have else F.lit(None)).cast("double").alias("confidence"),
    )


def _correct() -> Column:
    return F.count_if("is_correct")


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correct rows over all rows; 0.0 without rows."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        _correct().alias("correct_samples"),
        F.coalesce(F.avg(F.col("is_correct").cast("int")), F.lit(0.0)).alias("accuracy"),
    )


def per_problem(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempts and correct attempts of each problem; the one wide shuffle of the metrics."""
    correct_tokens = F.when(F.col("is_correct"), F.col("tokens_used"))
    return df.groupBy(*by, "sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        _correct().alias("c"),
        F.sum("tokens_used").alias("tokens"),
        F.sum(correct_tokens).alias("correct_tokens"),
        F.count("confidence").alias("n_conf"),
        F.sum("confidence").alias("sum_conf"),
        F.min("confidence").alias("min_conf"),
        F.max("confidence").alias("max_conf"),
    )


def _mean_pass_at_k(k: int) -> Column:
    """Mean over problems with at least k attempts; 0.0 when there is none."""
    n, c = F.col("n"), F.col("c")
    return F.coalesce(F.avg(F.when(n >= k, pass_at_k(n, c, k))), F.lit(0.0))


def pass_at_k_table(
    df: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = DEFAULT_KS
) -> DataFrame:
    """``(*by, pass_at_1, pass_at_3, …)`` from attempts that share a sample id."""
    problems = df.groupBy(*by, "sample_id").agg(
        F.count(F.lit(1)).alias("n"), _correct().alias("c")
    )
    return problems.groupBy(*by).agg(*[_mean_pass_at_k(k).alias(f"pass_at_{k}") for k in ks])


def token_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token totals, means per sample and per correct sample, correct answers per token."""
    tokens = F.col("tokens_used")
    total = F.coalesce(F.sum(tokens), F.lit(0))
    return df.groupBy(*by).agg(
        total.alias("total_tokens"),
        F.coalesce(F.avg(tokens), F.lit(0.0)).alias("avg_tokens_per_sample"),
        F.coalesce(F.avg(F.when(F.col("is_correct"), tokens)), F.lit(0.0)).alias(
            "avg_tokens_per_correct"
        ),
        token_efficiency(_correct(), total).alias("token_efficiency"),
    )


def confidence_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, bounds and population deviation of the known confidences; zeros without any."""
    c = F.col("confidence")
    stats = {"avg": F.avg(c), "min": F.min(c), "max": F.max(c), "std": F.stddev_pop(c)}
    return df.groupBy(*by).agg(
        *[F.coalesce(value, F.lit(0.0)).alias(f"{name}_confidence") for name, value in stats.items()]
    )


def problem_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, "sample_id").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("problem_count")
    )


def comprehensive(
    df: DataFrame, by: Sequence[str] = ("dataset",), ks: Sequence[int] = DEFAULT_KS
) -> DataFrame:
    """All overall metrics in one row per group: rows → problems → groups, one pass.

    Confidence columns are null when no confidence is known; a group without rows has no row.
    """
    total = F.sum("n")
    correct = F.sum("c")
    tokens = F.sum("tokens")
    n_conf = F.sum("n_conf")
    return per_problem(df, by).groupBy(*by).agg(
        total.alias("total_samples"),
        correct.alias("correct_samples"),
        ratio(correct, total).alias("accuracy"),
        *[_mean_pass_at_k(k).alias(f"pass_at_{k}") for k in ks],
        tokens.alias("total_tokens"),
        ratio(tokens, total).alias("avg_tokens_per_sample"),
        ratio(F.sum("correct_tokens"), correct).alias("avg_tokens_per_correct"),
        token_efficiency(correct, tokens).alias("token_efficiency"),
        F.try_divide(F.sum("sum_conf"), n_conf).alias("avg_confidence"),
        F.min("min_conf").alias("min_confidence"),
        F.max("max_conf").alias("max_confidence"),
        F.count(F.lit(1)).alias("problem_count"),
    )


def group_metrics(
    df: DataFrame, groups: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy per named problem group; a problem may be in several, empty groups vanish.

    ``groups`` is ``(group_name, sample_id)``. Attempts are summed per problem before the
    join, so a problem with many attempts enters it as one row.
    """
    problems = df.groupBy(*by, "sample_id").agg(
        F.count(F.lit(1)).alias("n"), _correct().alias("c")
    )
    members = groups.select("group_name", "sample_id").distinct()
    return (
        problems.join(members, "sample_id")
        .groupBy(*by, "group_name")
        .agg(F.sum("n").alias("count"), F.sum("c").alias("correct_count"))
        .withColumn("accuracy", ratio(F.col("correct_count"), F.col("count")))
    )


def attribute_metrics(df: DataFrame, by: Sequence[str], attribute: str) -> DataFrame:
    """Overall and per-attribute accuracy in one pass; ``is_overall`` marks the overall rows."""
    keys = [F.col(c) for c in by]
    return (
        df.groupingSets([keys, [*keys, F.col(attribute)]], *keys, F.col(attribute))
        .agg(
            (F.grouping(attribute) == 1).alias("is_overall"),
            F.count(F.lit(1)).alias("count"),
            _correct().alias("correct_count"),
        )
        .withColumn("accuracy", ratio(F.col("correct_count"), F.col("count")))
    )


def judge_statistics(
    df: DataFrame, judgment: str = "judgment", by: Sequence[str] = ()
) -> DataFrame:
    """Valid, correct and incorrect judgments; accuracy over all rows, invalid ones included."""
    label = verdict_label(F.col(judgment))
    correct = F.count_if(label == "correct")
    return df.groupBy(*by).agg(
        F.count_if(is_valid(F.col(judgment))).alias("valid_num"),
        correct.alias("correct_num"),
        F.count_if(label == "incorrect").alias("incorrect_num"),
        ratio(correct, F.count(F.lit(1))).alias("accuracy"),
    )


def progress(df: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_done"))


def metrics_documents(
    metrics: DataFrame,
    ks: Sequence[int] = DEFAULT_KS,
    info: Sequence[str] = (),
    grouped: DataFrame | None = None,
) -> DataFrame:
    """``(dataset, document)``: the nested JSON form of ``comprehensive`` rows.

    ``info`` names further columns for ``dataset_info``; ``grouped`` has the rows of
    ``group_metrics`` by dataset, which go in by the group's name.
    """
    figures = "accuracy double, count bigint, correct_count bigint"
    if grouped is None:
        metrics = metrics.withColumn("_groups", F.lit(None).cast(f"map<string,struct<{figures}>>"))
    else:
        entry = F.struct("group_name", F.struct("accuracy", "count", "correct_count"))
        by_name = grouped.groupBy("dataset").agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_groups")
        )
        metrics = metrics.join(by_name, "dataset", "left")
    no_confidence = F.col("avg_confidence").isNull()
    confidence = F.when(
        ~no_confidence, F.struct("avg_confidence", "min_confidence", "max_confidence")
    )
    pass_map = F.create_map(
        *[item for k in ks for item in (F.lit(str(k)), F.col(f"pass_at_{k}"))]
    )
    document = F.struct(
        F.struct(
            "total_samples", "correct_samples", "accuracy", pass_map.alias("pass_at_k")
        ).alias("overall"),
        F.struct(
            "total_tokens", "avg_tokens_per_sample", "avg_tokens_per_correct", "token_efficiency"
        ).alias("token_efficiency"),
        F.coalesce(
            "_groups", F.create_map().cast(f"map<string,struct<{figures}>>")
        ).alias("group_metrics"),
        F.coalesce(
            F.from_json(F.to_json(confidence), "map<string,double>"),
            F.create_map().cast("map<string,double>"),
        ).alias("confidence_metrics"),
        "problem_count",
        F.struct(F.col("dataset").alias("name"), "total_samples", *info).alias("dataset_info"),
    )
    return metrics.select("dataset", F.to_json(document).alias("document"))

"""Joins of the evaluation tables by key, never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.sizes import broadcast_if_small

SAMPLE_KEYS = ("dataset", "id")
# A template is a few kilobytes at most.
MAX_BROADCAST_TEMPLATES = 1_000
VERDICT_KEYS = ("run_id", "dataset", "id", "generation_id")


def join_generations(
    samples: DataFrame, generations: DataFrame, keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """Samples with each of their generations; a sample without any drops out.

    Samples are unique per key, so a key with many generations is skewed on one side only
    and adaptive skew-join splitting applies.
    """
    return samples.join(generations, list(keys))


def join_verdicts(
    responses: DataFrame, verdicts: DataFrame, keys: Sequence[str] = VERDICT_KEYS
) -> DataFrame:
    """Responses with their verdicts; unjudged responses drop out."""
    return responses.join(verdicts, list(keys))


def with_templates(prompts: DataFrame, templates: DataFrame, judge: str = "judge_name") -> DataFrame:
    """Adds the judge's chat ``template``; a judge without one is an error.

    ``templates`` is ``(judge_name, template)`` and must name each judge once.
    """
    missing = F.raise_error(F.concat(F.lit("Missing template for judge "), F.col(judge)))
    found = broadcast_if_small(
        templates.select(F.col("judge_name").alias("_judge"), F.col("template").alias("_template")),
        MAX_BROADCAST_TEMPLATES,
    )
    return (
        prompts.join(found, F.col(judge).eqNullSafe(F.col("_judge")), "left")
        .withColumn("template", F.coalesce("_template", missing.cast("string")))
        .drop("_judge", "_template")
    )

"""Verdicts on responses: clean, prompt, judge, parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.extraction import extract_answer
from evalspark.functions.prompts import JUDGE_TEMPLATE, judge_prompt
from evalspark.functions.text import clean_output, truncate_tokens
from evalspark.functions.verdicts import is_correct, is_valid
from evalspark.operators.dealing import deal_by_cost
from evalspark.operators.inference import ModelFactory, model_column
from evalspark.operators.response_store import stored_calls
from evalspark.schema import GenerationConfig

JUDGE_CONFIG = GenerationConfig(temperature=0.1, max_tokens=50)


def clean_outputs(
    responses: DataFrame,
    output: str = "model_output",
    max_tokens: int = 0,
    tail: int | None = None,
) -> DataFrame:
    return responses.withColumn(
        "clean_output", truncate_tokens(clean_output(F.col(output), tail), max_tokens)
    )


def extract_answers(
    responses: DataFrame, rule: str = "output", text: str = "model_output"
) -> DataFrame:
    return responses.withColumn("extracted", extract_answer(F.col(text), rule))


def judge_inputs(responses: DataFrame) -> DataFrame:
    """Responses under the names judges use."""
    return responses.select(
        F.col("problem").alias("question"),
        "model_output",
        F.col("answer").alias("correct_answer"),
        "id",
    )


def _prompt(template: str, clean: bool, tail: int | None) -> Column:
    output = F.col("model_output")
    shown = clean_output(output, tail) if clean else output
    return judge_prompt(F.col("problem"), shown, F.col("answer"), template)


def _with_verdict(df: DataFrame, judgment: Column, mode: str, metadata: Column) -> DataFrame:
    return df.withColumns(
        {
            "is_correct": is_correct(judgment, mode),
            "evaluation_reasoning": judgment,
            "evaluation_confidence": F.lit(None).cast("double"),
            "evaluation_metadata": metadata,
        }
    )


def judge(
    responses: DataFrame,
    make_judge: ModelFactory,
    template: str = JUDGE_TEMPLATE,
    mode: str = "prefix",
    clean: bool = True,
    config: GenerationConfig = JUDGE_CONFIG,
    batch_size: int = 32,
    tail: int | None = None,
    partitions: int | None = None,
    store: str | None = None,
    judge_name: str = "",
) -> DataFrame:
    """Responses with ``is_correct`` and the judge's text.

    A judge sees the cleaned output, its last ``tail`` characters if given. It is called in the responses'
    partitions; those of a table are packed by bytes and can be few for a slow judge, so
    ``partitions`` deals the rows out first, to tasks of equal prompt length, the longest first. With
    ``store``, calls of the judge ``judge_name`` are kept in that folder: equal prompts are judged once, and a run that broke off
    goes on where it stopped.
    """
    prompt = _prompt(template, clean, tail)
    if store is not None:
        called = stored_calls(
            responses, prompt, make_judge, config, store, judge_name, batch_size, partitions
        ).withColumnRenamed("_generations", "_judged")
    else:
        rows = responses
        if partitions is not None:
            length = F.length("model_output") + F.coalesce(F.length("problem"), F.lit(0))
            rows = deal_by_cost(responses, length, partitions)
        called = rows.withColumn("_judged", model_column(prompt, make_judge, config, batch_size))
    called = called.withColumn("_judged", F.get("_judged", F.lit(0)))
    metadata = F.struct(
        F.lit("batch").alias("evaluation_mode"),
        F.col("_judged.tokens_used").alias("tokens_used"),
        F.col("_judged.finish_reason").alias("finish_reason"),
    )
    return _with_verdict(called, F.col("_judged.text"), mode, metadata).drop("_judged")


def verdicts_from_column(responses: DataFrame, judgment: str, mode: str = "prefix") -> DataFrame:
    """Verdicts from judge text that is already in a column."""
    metadata = F.struct(
        F.lit("given").alias("evaluation_mode"),
        F.lit(None).cast("bigint").alias("tokens_used"),
        F.lit(None).cast("string").alias("finish_reason"),
    )
    return _with_verdict(responses, F.col(judgment), mode, metadata)


def parse_verdicts(df: DataFrame, judgment: str = "judgment", mode: str = "prefix") -> DataFrame:
    return df.withColumn("is_correct", is_correct(F.col(judgment), mode)).withColumn(
        "judge_valid", is_valid(F.col(judgment))
    )

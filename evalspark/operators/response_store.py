"""Model calls that are kept, so that a prompt is called once, however often it is asked.

A call is known by the digest of the model's name, the generation parameters and the prompt. Calls are kept in a
``KeyedHistory``: a run looks up its prompts, calls the model for those that are missing, one of each, and writes
the results in waves. A run that breaks off loses the wave it was in; run again, it calls what is still missing.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.dealing import deal_by_cost
from evalspark.operators.inference import ModelFactory, model_column
from evalspark.operators.sizes import broadcast_if_small
from evalspark.schema import GENERATIONS_TYPE, GenerationConfig
from evalspark.streaming.history import MERGED_BATCHES, KeyedHistory

WAVE_ROWS = 100_000


def call_key(prompt: Column, config: GenerationConfig, model: str) -> Column:
    """Digest of all that decides a call; texts, chat messages and null differ from each other."""
    settings = json.dumps([model, asdict(config)], sort_keys=True)
    shown = F.to_json(F.struct(prompt.alias("prompt")), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(settings), F.lit("\n"), shown), 256)


def call_store(spark: SparkSession, path: str) -> KeyedHistory:
    return KeyedHistory(spark, path, ["call"], f"call string, generations {GENERATIONS_TYPE}")


def stored_calls(
    df: DataFrame,
    prompt: Column,
    make_model: ModelFactory,
    config: GenerationConfig,
    store: str,
    model: str,
    batch_size: int = 32,
    partitions: int | None = None,
    wave_rows: int = WAVE_ROWS,
) -> DataFrame:
    """``df`` with ``_generations``, the model's results for each row's prompt, taken from or added to ``store``.

    Rows of equal prompts share one call, also one that draws at random: give prompts that are to be drawn anew a
    different ``model`` name or seed. Prompts are called longest first, in tasks of equal cost where ``partitions`` is
    given. One run writes to a store at a time.
    """
    spark = df.sparkSession
    history = call_store(spark, store)
    keyed = df.withColumn("_call", call_key(prompt, config, model))
    wanted = keyed.select(F.col("_call").alias("call"), prompt.alias("_prompt"))
    # equal prompts fold in their tasks before the shuffle
    once = wanted.groupBy("call").agg(F.first("_prompt").alias("_prompt"))
    known = history.candidates(wanted.select("call").distinct()).select("call").distinct()
    missing = once.join(broadcast_if_small(known), "call", "left_anti").persist()
    waves = -(-missing.count() // wave_rows)
    done = max((segment.last for segment in history.segments()), default=-1)
    for wave in range(waves):
        part = missing.where(F.pmod(F.xxhash64("call"), F.lit(waves)) == wave)
        if partitions is not None:
            part = deal_by_cost(part, F.length(F.col("_prompt").cast("string")), partitions)
        results = model_column(F.col("_prompt"), make_model, config, batch_size)
        history.add(part.select("call", results.alias("generations")), done + 1 + wave)
    missing.unpersist()
    history.merge(MERGED_BATCHES, before=done + waves)
    found = history.candidates(wanted.select("call").distinct()).select(
        F.col("call").alias("_call"), F.col("generations").alias("_generations")
    )
    # a call that two runs made at a time is there twice
    unique = found.groupBy("_call").agg(F.first("_generations").alias("_generations"))
    return keyed.join(unique, "_call").drop("_call")

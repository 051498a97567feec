"""Batch calls of user-supplied models inside Spark tasks.

Only the prompt column crosses to Python, in Arrow batches; every other column stays in the
JVM. The model is built once per task by the factory the caller passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import evalspark
from evalspark.schema import GENERATIONS_TYPE, GenerationConfig

# functions of this package travel to the workers whole, so it need not be installed there
cloudpickle.register_pickle_by_value(evalspark)

# model(prompts, config) -> for each prompt a list of config.n results with the keys
# text, tokens_used and, if the model knows them, finish_reason or saw_eos
Model = Callable[[Sequence[Any], GenerationConfig], Sequence[Sequence[dict]]]
ModelFactory = Callable[[], Model]

# GENERATIONS_TYPE, as Arrow has it
_ARROW_TYPE = pa.list_(
    pa.struct(
        [("text", pa.string()), ("tokens_used", pa.int64()), ("finish_reason", pa.string()), ("saw_eos", pa.bool_())]
    )
)


def finish_reason(tokens: Column, max_tokens: int, saw_eos: Column) -> Column:
    return (
        F.when(tokens >= max_tokens, F.lit("length"))
        .when(F.coalesce(saw_eos, F.lit(False)), F.lit("eos"))
        .otherwise(F.lit("stop"))
    )


def _result(raw: dict) -> dict:
    return {
        "text": raw["text"],
        "tokens_used": raw.get("tokens_used"),
        "finish_reason": raw.get("finish_reason"),
        "saw_eos": raw.get("saw_eos"),
    }


def model_column(
    prompt: Column, make_model: ModelFactory, config: GenerationConfig, batch_size: int
) -> Column:
    """Array of generations per prompt, called in slices of ``batch_size``."""
    @F.arrow_udf(GENERATIONS_TYPE)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for given in batches:
            prompts = given.to_pandas().tolist()
            results: list[list[dict]] = []
            for start in range(0, len(prompts), batch_size):
                part = prompts[start : start + batch_size]
                answers = list(model(part, config))
                if len(answers) != len(part):
                    raise ValueError("the model must return one list of results per prompt")
                results.extend([_result(r) for r in answer] for answer in answers)
            # Arrow builds the column itself; pandas would convert every value in Python
            yield pa.array(results, _ARROW_TYPE)

    return call.asNondeterministic()(prompt)


def generate(
    df: DataFrame,
    make_model: ModelFactory,
    config: GenerationConfig | None = None,
    prompt: str = "prompt",
    batch_size: int = 16,
    partitions: int | None = None,
    store: str | None = None,
    model: str = "",
) -> DataFrame:
    """One row per prompt and generation with ``generation_id``, output, tokens, finish reason.

    Scan partitions can be few and large for a slow model; ``partitions`` spreads the rows
    evenly first. Write the result before reading it twice: a model call is expensive and
    may not repeat itself. With ``store``, calls of the ``model`` of that name are kept in that folder:
    equal prompts are called once, and a run that broke off goes on where it stopped.
    """
    config = config or GenerationConfig()
    if store is not None:
        from evalspark.operators.response_store import stored_calls

        called = stored_calls(df, F.col(prompt), make_model, config, store, model, batch_size, partitions)
    else:
        rows = df if partitions is None else df.repartition(partitions)
        called = rows.withColumn(
            "_generations", model_column(F.col(prompt), make_model, config, batch_size)
        )
    exploded = called.select("*", F.posexplode("_generations").alias("generation_id", "_g"))
    tokens = F.coalesce("_g.tokens_used", F.lit(0).cast("bigint"))
    return exploded.select(
        *df.columns,
        "generation_id",
        F.col("_g.text").alias("model_output"),
        tokens.alias("tokens_used"),
        F.coalesce(
            "_g.finish_reason", finish_reason(tokens, config.max_tokens, F.col("_g.saw_eos"))
        ).alias("finish_reason"),
    )

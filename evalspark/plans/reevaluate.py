"""Re-evaluation of response files with another judge."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.metrics import DEFAULT_KS
from evalspark.plans.benchmark import METRIC_KEYS, run_metrics, write_summary
from evalspark.sinks.commits import run_commit
from evalspark.sinks.tables import read_run_table, run_folder, write_run_table
from evalspark.sources.responses import load_responses, response_field
from evalspark.streaming.incremental import KEYS, collapse_copies

# responses -> verdicts, for example a call of judge() or verdicts_from_column()
Judge = Callable[[DataFrame], DataFrame]


def readable(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("error").isNull()).drop("error", "raw", "file")


def attribute_table(
    results: DataFrame, attributes: Mapping[str, str], ks: Sequence[int] = DEFAULT_KS, tokens: str = "tokens_used"
) -> DataFrame:
    """All metrics for each value of each attribute; all attributes in one pass over the results."""
    pairs = [
        F.struct(F.lit(name).alias("attribute"), response_field(path).alias("value")) for name, path in attributes.items()
    ]
    rows = results.withColumn("_pair", F.explode(F.array(*pairs))).select("*", "_pair.*").drop("_pair")
    return run_metrics(rows, ks, (*METRIC_KEYS, "attribute", "value"), tokens)


def reevaluate(
    spark: SparkSession,
    results_dir: str,
    out_dir: str,
    judge: Judge,
    run_id: str,
    ks: Sequence[int] = DEFAULT_KS,
    tokens: str = "tokens_used",
    attributes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Judges every ``*_responses.jsonl`` of a folder and returns the metrics rows.

    A response delivered more than once counts once. Lines that can't be read go to the table
    ``quarantine`` with the reason.

    All fields of a response stay: those without a column are in ``fields`` of the results. ``attributes`` names
    fields to group by, such as ``{"level": "metadata.level"}``; the table ``attributes`` then has the metrics of each
    of their values, by ``attribute`` and ``value``.

    ``tokens`` is ``tokens_used`` for the generator's count or
    ``evaluation_metadata.tokens_used`` for the judge's.
    """
    out = out_dir.rstrip("/")
    loaded = load_responses(spark, results_dir).withColumn("run_id", F.lit(run_id))
    unreadable = loaded.filter(F.col("error").isNotNull())
    with run_commit(spark, out, run_id) as stages:

        def write_stage(rows: DataFrame, name: str) -> DataFrame:
            write_run_table(rows, f"{out}/{name}", run_id)
            stages[name] = run_folder(f"{out}/{name}", run_id)
            return read_run_table(spark, f"{out}/{name}", run_id)

        bad = unreadable.select("run_id", "dataset", "file", "raw", "error")
        write_run_table(bad, f"{out}/quarantine", run_id)
        once = collapse_copies(loaded.filter(F.col("error").isNull()), KEYS)
        results = write_stage(judge(once.drop("error", "raw", "file")), "results")
        if attributes:
            write_stage(attribute_table(results, attributes, ks, tokens), "attributes")
        written = write_stage(run_metrics(results, ks, tokens=tokens), "metrics")
        write_summary(written, f"{out}/summary/run_id={run_id}", ks)
    return written

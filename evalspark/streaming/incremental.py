"""Evaluation of responses as their files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.scoring import ratio, token_efficiency
from evalspark.operators.metrics import DEFAULT_KS
from evalspark.operators.sizes import MAX_BROADCAST_ROWS, broadcast_if_small
from evalspark.plans.benchmark import run_metrics
from evalspark.schema import RESPONSE_KEYS
from evalspark.sources.folders import exists, partition_values
from evalspark.sources.responses import stream_responses
from evalspark.streaming.history import MERGED_BATCHES, KeyedHistory
from evalspark.streaming.state import MetricState

KEYS = ("run_id", *RESPONSE_KEYS)


def collapse_copies(responses: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per response, the earliest delivery; copies fold before the shuffle.

    ``min_by`` merges partially in each task, so a response delivered very often sends one
    row per task.
    """
    row = F.struct(*[c for c in responses.columns if c not in keys])
    order = F.struct(*[c for c in ("arrived_at", "file", "raw") if c in responses.columns])
    return (
        responses.groupBy(*keys)
        .agg(F.min_by(row, order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*responses.columns)
    )


def drop_redelivered(
    responses: DataFrame, delay: str = "1 day", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Streaming variant with bounded state: copies within ``delay`` of the first are dropped.

    Time is that of reading: a file with an old time stamp isn't late.
    """
    read = responses.withColumn("_read_at", F.current_timestamp())
    unique = read.withWatermark("_read_at", delay).dropDuplicatesWithinWatermark(list(keys))
    return unique.drop("_read_at")


def verdict_history(spark: SparkSession, out_dir: str) -> KeyedHistory:
    """Keys of the responses judged so far, by batch."""
    schema = ", ".join(f"{k} {'int' if k == 'generation_id' else 'string'}" for k in KEYS)
    return KeyedHistory(spark, f"{out_dir.rstrip('/')}/history", KEYS, schema)


def metric_state(spark: SparkSession, out_dir: str) -> MetricState:
    """Metrics of each dataset, updated by every batch."""
    return MetricState(spark, f"{out_dir.rstrip('/')}/state", ("dataset",))


def evaluate_stream(
    spark: SparkSession,
    results_dir: str,
    out_dir: str,
    judge: Callable[[DataFrame], DataFrame],
    checkpoint_dir: str,
    available_now: bool = True,
    files_per_trigger: int = 1000,
    keep_state: bool = True,
) -> StreamingQuery:
    """Judges arriving response files into ``{out_dir}/verdicts``, once per response.

    Each micro-batch replaces its own ``batch_id`` partition, so a repeated batch leaves no
    copies. Re-delivered responses are folded within the batch. Earlier batches are asked through
    ``{out_dir}/history``: only those buckets of keys are opened whose filters may have a key that arrived.
    ``{out_dir}/state`` takes in each batch's verdicts, unless ``keep_state`` is false. A repeated batch writes verdicts, history and state anew
    and does not see its own rows. Lines that cannot be read go to ``{out_dir}/quarantine``.
    """
    out = out_dir.rstrip("/")

    def replace_batch(df: DataFrame, name: str, batch_id: int) -> None:
        (
            df.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(f"{out}/{name}")
        )

    def take_in(history: KeyedHistory, batch_id: int) -> None:
        """Verdicts of batches that have no history yet, as an earlier version left them."""
        session, segments = history.spark, history.segments()
        for other in sorted({int(v) for v in partition_values(session, f"{out}/verdicts", "batch_id")}):
            if other != batch_id and not any(s.covers(other) for s in segments):
                history.add(session.read.parquet(f"{out}/verdicts/batch_id={other}"), other)

    def unknown(arrived: DataFrame, history: KeyedHistory, batch_id: int) -> DataFrame:
        """The rows of ``arrived`` that no earlier batch had."""
        keys = list(KEYS)
        opened = history.opened(arrived.select(*keys), history.others(batch_id))
        if not opened:
            return arrived
        few = arrived.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        arrived_keys = arrived.select(*keys)
        found = history.rows_in(opened).join(F.broadcast(arrived_keys) if few else arrived_keys, keys, "left_semi")
        again = found.select(*keys).distinct()
        # no more than the keys that arrived
        return arrived.join(F.broadcast(again) if few else broadcast_if_small(again), keys, "left_anti")

    started = []

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # kept rows aren't packed by bytes: without this each look at them takes a task for every shuffle partition
        tasks = max(batch.rdd.getNumPartitions(), session.sparkContext.defaultParallelism)
        rows = batch.persist()
        bad = rows.filter(F.col("error").isNotNull()).select("file", "raw", "error")
        replace_batch(bad, "quarantine", batch_id)
        arrived = collapse_copies(rows.filter(F.col("error").isNull())).coalesce(tasks).persist()
        history = verdict_history(session, out)
        if not started:
            # each batch writes its own history, so only the start can find verdicts without
            take_in(history, batch_id)
            started.append(batch_id)
        verdicts = judge(unknown(arrived, history, batch_id).drop("error", "raw"))
        replace_batch(verdicts, "verdicts", batch_id)
        arrived.unpersist()
        rows.unpersist()
        written = f"{out}/verdicts/batch_id={batch_id}"
        if exists(session, written):
            judged = session.read.schema(verdicts.schema).parquet(written)
            history.add(judged, batch_id)
            history.merge(MERGED_BATCHES, before=batch_id)
            if keep_state:
                metric_state(session, out).update(judged, batch_id)

    writer = (
        stream_responses(spark, results_dir, files_per_trigger)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_dir)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_metrics(
    spark: SparkSession, out_dir: str, ks: Sequence[int] = DEFAULT_KS
) -> DataFrame:
    """All metrics of the verdicts so far, computed anew; ``metric_state`` has them without reading verdicts."""
    verdicts = spark.read.parquet(f"{out_dir.rstrip('/')}/verdicts")
    return run_metrics(verdicts, ks, by=("dataset",))


def running_metrics(verdicts: DataFrame) -> DataFrame:
    """Accuracy and token efficiency per dataset of a verdict stream (complete mode)."""
    correct = F.count_if("is_correct")
    tokens = F.sum("tokens_used")
    return verdicts.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_samples"),
        correct.alias("correct_samples"),
        ratio(correct, F.count(F.lit(1))).alias("accuracy"),
        tokens.alias("total_tokens"),
        token_efficiency(correct, tokens).alias("token_efficiency"),
    )

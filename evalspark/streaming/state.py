"""Metrics of a verdict stream, kept up to date by each batch's difference.

Three small tables follow the stream, each with a version for every batch. ``problems`` has the attempts and correct
attempts of every problem, written for the problems of a batch only and found by key. ``cells`` counts the problems of
a group by (attempts, correct attempts); a problem that gets more attempts moves from one cell to another. As pass@k
depends on these two numbers alone, any k follows from the cells. ``sums`` adds up tokens and confidences. All counts
are integers, so nothing drifts, and no verdict of an earlier batch is read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.reporting import iso_stamp
from evalspark.functions.scoring import pass_at_k, ratio, token_efficiency
from evalspark.operators.metrics import DEFAULT_KS, metric_rows, per_problem
from evalspark.sources.folders import exists, partition_values
from evalspark.streaming.history import MERGED_BATCHES, KeyedHistory

SUMS = {"tokens": "bigint", "correct_tokens": "bigint", "n_conf": "bigint", "sum_conf": "double"}
BOUNDS = {"min_conf": F.min, "max_conf": F.max}


class MetricState:
    """The state under ``path``; ``by`` names the text columns that metrics are grouped by."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ("dataset",)):
        self.spark, self.by, self.path = spark, list(by), path.rstrip("/")
        groups = ", ".join(f"`{c}` string" for c in self.by)
        self.cells_schema = f"{groups}, n bigint, c bigint, problems bigint"
        kinds = {**SUMS, **{name: "double" for name in BOUNDS}}
        self.sums_schema = f"{groups}, " + ", ".join(f"{name} {kind}" for name, kind in kinds.items())
        self.problems = KeyedHistory(
            spark, f"{self.path}/problems", [*self.by, "sample_id"], f"{groups}, sample_id string, n bigint, c bigint"
        )

    def versions(self) -> list[int]:
        """Batches that the state has taken in; the sums of a batch are written last."""
        return sorted(int(v) for v in partition_values(self.spark, f"{self.path}/sums", "batch_id"))

    def _before(self, batch_id: int) -> int | None:
        """The latest version before a batch: as a rule the batch before, so no list of all is asked for."""
        if exists(self.spark, f"{self.path}/sums/batch_id={batch_id - 1}"):
            return batch_id - 1
        return max((v for v in self.versions() if v < batch_id), default=None)

    def _version(self, name: str, schema: str, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch_id={version}")

    def update(self, verdicts: DataFrame, batch_id: int, tokens: str = "tokens_used") -> None:
        """Takes in a batch's verdicts. Doing a batch again gives the same state: only versions before it are read.

        Batches come in ascending order, as a stream numbers them. A null group counts as the empty name.
        """
        last = self._before(batch_id)
        named = verdicts.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in self.by})
        # kept rows aren't packed by bytes: without this each look at them takes a task for every shuffle partition
        tasks = max(named.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism)
        new = per_problem(metric_rows(named, self.by, tokens=tokens), self.by).coalesce(tasks).persist()
        before = [s for s in self.problems.others(batch_id) if s.last < batch_id]
        old = self.problems.latest(new, before).withColumnsRenamed({"n": "_n", "c": "_c"})
        moved = new.join(old, [*self.by, "sample_id"], "left").select(
            *self.by,
            "sample_id",
            (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            (F.col("c") + F.coalesce("_c", F.lit(0))).alias("c"),
            "_n",
            "_c",
        ).coalesce(tasks).persist()
        self.problems.add(moved.drop("_n", "_c"), batch_id)
        left = moved.where("_n IS NOT NULL").select(
            *self.by, F.col("_n").alias("n"), F.col("_c").alias("c"), F.lit(-1).cast("bigint").alias("problems")
        )
        entered = moved.select(*self.by, "n", "c", F.lit(1).cast("bigint").alias("problems"))
        cells = (
            self._version("cells", self.cells_schema, last)
            .unionByName(entered)
            .unionByName(left)
            .groupBy(*self.by, "n", "c")
            .agg(F.sum("problems").alias("problems"))
            .where("problems <> 0")
        )
        cells.write.mode("overwrite").parquet(f"{self.path}/cells/batch_id={batch_id}")
        sums = (
            self._version("sums", self.sums_schema, last)
            .unionByName(new.select(*self.by, *[F.col(n).cast(k) for n, k in SUMS.items()], *BOUNDS))
            .groupBy(*self.by)
            .agg(*[F.sum(name).alias(name) for name in SUMS], *[f(name).alias(name) for name, f in BOUNDS.items()])
        )
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch_id={batch_id}")
        moved.unpersist()
        new.unpersist()
        self.problems.merge(MERGED_BATCHES, before=batch_id)

    def metrics(self, ks: Sequence[int] = DEFAULT_KS, version: int | None = None) -> DataFrame:
        """All metrics as of a batch, the last one by default; the columns of ``comprehensive``."""
        versions = self.versions()
        at = version if version is not None else (versions[-1] if versions else None)
        n, c, problems = F.col("n"), F.col("c"), F.col("problems")

        def mean_pass_at(k: int) -> F.Column:
            enough = F.when(n >= k, problems)
            chance = F.when(n >= k, problems * pass_at_k(n, c, k))
            return F.coalesce(F.try_divide(F.sum(chance), F.sum(enough)), F.lit(0.0))

        cells = self._version("cells", self.cells_schema, at).groupBy(*self.by).agg(
            F.sum(n * problems).alias("total_samples"),
            F.sum(c * problems).alias("correct_samples"),
            *[mean_pass_at(k).alias(f"pass_at_{k}") for k in ks],
            F.sum(problems).alias("problem_count"),
        )
        sums = self._version("sums", self.sums_schema, at)
        total, correct, tokens = F.col("total_samples"), F.col("correct_samples"), F.col("tokens")
        same = [F.col(f"cells.{name}").eqNullSafe(F.col(f"sums.{name}")) for name in self.by]
        joined = cells.alias("cells").join(sums.alias("sums"), same)
        return joined.select(
            *[F.col(f"cells.{name}") for name in self.by],
            total,
            correct,
            ratio(correct, total).alias("accuracy"),
            *[F.col(f"pass_at_{k}") for k in ks],
            tokens.alias("total_tokens"),
            ratio(tokens, total).alias("avg_tokens_per_sample"),
            ratio(F.col("correct_tokens"), correct).alias("avg_tokens_per_correct"),
            token_efficiency(correct, tokens).alias("token_efficiency"),
            F.try_divide("sum_conf", "n_conf").alias("avg_confidence"),
            F.col("min_conf").alias("min_confidence"),
            F.col("max_conf").alias("max_confidence"),
            F.col("problem_count"),
            iso_stamp(F.current_timestamp()).alias("evaluation_timestamp"),
        )

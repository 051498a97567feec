"""Rows of earlier batches by key, found without reading the history.

A batch's rows are written by bucket of their key's hash, with a Bloom filter for each bucket. A later batch reads
only the filters of the buckets that its own keys fall into, and opens only those buckets of those batches whose filter
may have one of its keys; the rows found there are compared by key. Batches are merged to few segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import evalspark
from evalspark.operators.sizes import broadcast_if_small
from evalspark.sources.folders import delete, partition_values

# functions of this package travel to the workers whole, so it need not be installed there
cloudpickle.register_pickle_by_value(evalspark)

BUCKETS = 32
BITS_PER_KEY = 20
PROBES = 8
LEAST_BITS = 1024
# so many batches become one segment
MERGED_BATCHES = 32
FILTER_SCHEMA = "bucket int, bits bigint, filter binary"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each hash, a row of ``PROBES`` a key."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    turns = np.arange(PROBES, dtype=np.uint64)
    return ((h[:, None] + turns * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter(rows: pa.Table) -> pa.Table:
    hashes = np.asarray(rows.column("hash"))
    bits = max(LEAST_BITS, len(hashes) * BITS_PER_KEY)
    table = np.zeros(-(-bits // 8) * 8, dtype=bool)
    table[_places(hashes, bits).ravel()] = True
    return pa.table(
        {
            "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()),
            "bits": pa.array([bits], pa.int64()),
            "filter": pa.array([np.packbits(table).tobytes()], pa.binary()),
        }
    )


def _hits(wanted: pa.Table, filters: pa.Table) -> pa.Table:
    """Segments whose filter of this bucket may have one of the wanted keys."""
    hashes = np.asarray(wanted.column("hash"))
    found = []
    if len(hashes):
        for row in filters.to_pylist():
            table = np.unpackbits(np.frombuffer(row["filter"], np.uint8)).astype(bool)
            if table[_places(hashes, row["bits"])].all(axis=1).any():
                found.append((row["bucket"], row["segment"]))
    return pa.table(
        {
            "bucket": pa.array([f[0] for f in found], pa.int32()),
            "segment": pa.array([f[1] for f in found], pa.string()),
        }
    )


@dataclass(frozen=True, order=True)
class Segment:
    """The batches from ``first`` to ``last``: one batch, or several that were merged."""

    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}"

    @property
    def batches(self) -> int:
        return self.last - self.first + 1

    def covers(self, batch: int) -> bool:
        return self.first <= batch <= self.last


class KeyedHistory:
    """Rows under ``path`` by batch; ``schema`` (DDL) names their columns, the key columns among them.

    A key occurs once in a batch; it may occur in several. Writing a batch again replaces it. Null keys equal
    nothing and are never found. A batch costs a file for each bucket that its keys fall into; ``merge`` makes
    one segment of many batches, with the latest row of each key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.rows_path, self.filters_path = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/filters"
        self.schema = T.StructType.fromDDL(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])

    def segments(self) -> list[Segment]:
        """Segments that are wholly written; those that a merged one covers don't count.

        A missing folder is an empty history, any other fault an error.
        """
        names = partition_values(self.spark, self.filters_path, "segment")
        found = sorted(Segment(*map(int, name.split("-"))) for name in names)
        return [s for s in found if not any(o != s and o.covers(s.first) and o.covers(s.last) for o in found)]

    def knows(self, batch_id: int) -> bool:
        return any(s.covers(batch_id) for s in self.segments())

    def others(self, batch_id: int) -> list[Segment]:
        """All segments but the batch's own; a batch that was merged with others can't be told from them."""
        found = [s for s in self.segments() if s != Segment(batch_id, batch_id)]
        if any(s.covers(batch_id) for s in found):
            raise ValueError(f"batch {batch_id} is older than the history; was the stream's checkpoint lost?")
        return found

    def _hashed(self, rows: DataFrame) -> DataFrame:
        key_hash = F.xxhash64(*self.keys)
        return rows.withColumn("hash", key_hash).withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, segment: Segment) -> None:
        """Writes a segment's rows, then their filters: it counts once its filters are there."""
        folder = f"{self.rows_path}/segment={segment.name}"
        # a file for each bucket: the few rows of a batch would go to one task, which writes them one by one
        tasks = min(self.buckets, self.spark.sparkContext.defaultParallelism)
        (
            self._hashed(rows)
            .repartition(tasks, "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("bucket")
            .parquet(folder)
        )
        hashes = self.spark.read.schema("hash bigint, bucket int").parquet(folder)
        filters = hashes.groupBy("bucket").applyInArrow(_filter, FILTER_SCHEMA)
        filters.coalesce(1).sortWithinPartitions("bucket").write.mode("overwrite").parquet(
            f"{self.filters_path}/segment={segment.name}"
        )

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Writes a batch, or replaces it."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        self._write(named.withColumn("batch_id", F.lit(batch_id).cast("bigint")), Segment(batch_id, batch_id))

    def merge(self, most: int, before: int) -> None:
        """Once ``most`` or more segments lie before that batch, makes one of them, or of the later ones.

        The filters that a later batch reads are as many as the segments, so their number stays bounded. First segments
        that each have more batches than all after them stay as they are, up to half of ``most``, so a row is written
        again a number of times that grows with the logarithm of the batches. The merged segment counts from when it
        is whole; then those it covers are deleted.
        """
        old = [s for s in self.segments() if s.last < before]
        if len(old) < max(2, most):
            return
        for _ in range(most // 2 - 1):
            if 2 * old[0].batches <= sum(s.batches for s in old):
                break
            old = old[1:]
        whole = Segment(old[0].first, max(s.last for s in old))
        rows = self.rows_in([f"{self.rows_path}/segment={s.name}" for s in old])
        self._write(self._latest(rows).select(*[f.name for f in self.stored]), whole)
        for segment in old:
            # first the filters: rows without filters are no part of the history
            delete(self.spark, f"{self.filters_path}/segment={segment.name}")
            delete(self.spark, f"{self.rows_path}/segment={segment.name}")

    def opened(self, wanted: DataFrame, segments: Iterable[Segment]) -> list[str]:
        """The folders that may have a wanted key; at most buckets times segments."""
        hashed = self._hashed(wanted).select("bucket", "hash")
        touched = [r["bucket"] for r in hashed.select("bucket").distinct().collect()]  # at most ``buckets``
        folders = [f"{self.filters_path}/segment={s.name}" for s in segments]
        if not touched or not folders:
            return []
        filters = (
            self.spark.read.schema(f"{FILTER_SCHEMA}, segment string")
            .option("basePath", self.filters_path)
            .parquet(*folders)
            .where(F.col("bucket").isin(touched))
        )
        pairs = (
            hashed.groupBy("bucket")
            .cogroup(filters.groupBy("bucket"))
            .applyInArrow(_hits, "bucket int, segment string")
        )
        return sorted(f"{self.rows_path}/segment={r['segment']}/bucket={r['bucket']}" for r in pairs.collect())

    def rows_in(self, folders: Sequence[str]) -> DataFrame:
        """Rows, with their ``batch_id``, of folders that ``opened`` names."""
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        rows = self.spark.read.schema(self.stored).option("basePath", self.rows_path).parquet(*folders)
        return rows.select(*[f.name for f in self.stored])

    def candidates(self, wanted: DataFrame, segments: Iterable[Segment] | None = None) -> DataFrame:
        """Rows, with their ``batch_id``, of the folders that may have a wanted key.

        ``wanted`` has the key columns; ``segments`` are those to look into, by default all.
        """
        chosen = self.segments() if segments is None else segments
        return self.rows_in(self.opened(wanted.select(*self.keys), chosen))

    def _latest(self, rows: DataFrame) -> DataFrame:
        values = [f.name for f in self.schema if f.name not in self.keys]
        row = F.max(F.struct("batch_id", *values)).alias("_row")
        return rows.groupBy(*self.keys).agg(row).select(*self.keys, "_row.*")

    def latest(self, wanted: DataFrame, segments: Iterable[Segment] | None = None) -> DataFrame:
        """For each wanted key that those segments have, the row of the latest batch."""
        found = self.candidates(wanted, segments).join(
            broadcast_if_small(wanted.select(*self.keys).distinct()), self.keys, "left_semi"
        )
        return self._latest(found).select(*[f.name for f in self.schema])

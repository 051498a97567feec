"""Helpers shared by the corpus operators: text batches, hashes, files in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import evalspark

# functions of this package travel to the workers whole, so it need not be installed there
cloudpickle.register_pickle_by_value(evalspark)

# Python tasks take the rows of an Arrow batch in slices of about this much text
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` to ``path`` in the shared folder and reads it back: the lineage ends there."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI in the shared folder, as Python tasks open it."""
    if "://" in path or path.startswith("file:"):
        uri = path if "://" in path else "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of at most ``limit`` bytes of ``column``.

    A value longer than the limit makes a slice of its own.
    """
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for row, length in enumerate(lengths.tolist()):
        if row > start and held + length > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8; null is the empty text."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [b"" if v is None else v for v in values.cast(kind).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if v is None else v for v in batch.column(column).to_pylist()]


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, which at its end gives the memory that it freed back to the system.

    A Python worker outlives its task and would hold that memory beside what later tasks take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # not all systems have it
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply); every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns put in place of those of the same name, or added at the end."""
    names = list(batch.schema.names)
    arrays = [columns.get(n, batch.column(i)) for i, n in enumerate(names)]
    for name, values in columns.items():
        if name not in names:
            names.append(name)
            arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def output_schema(df: DataFrame, added: dict[str, str]) -> str:
    """DDL of ``df``'s columns with ``added`` in place of columns of the same name, or at the end."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | added
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in kinds.items())

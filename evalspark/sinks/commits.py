"""Runs that count only once they are complete.

A run's writer holds a lock file, which only one can create. When all stages are written, a manifest with
the files and rows of each stage is moved into place; readers take runs that have one. A run that breaks off has no manifest,
and a run that is written again has none until it is complete again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

from evalspark.sources.blocks import list_files
from evalspark.sources.folders import exists

MANIFEST_SCHEMA = "run_id string, stage string, files bigint, bytes bigint, rows bigint"


class RunConflict(RuntimeError):
    """Another writer has the run."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(out: str) -> str:
    return f"{out.rstrip('/')}/commits"


def _manifest(out: str, run_id: str) -> str:
    return f"{_folder(out)}/manifests/{quote(run_id, safe='')}.json"


def _lock(out: str, run_id: str) -> str:
    return f"{_folder(out)}/locks/{quote(run_id, safe='')}"


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, False)


def release(spark: SparkSession, out: str, run_id: str) -> None:
    """Removes the lock of a writer that is known to be gone."""
    _delete(spark, _lock(out, run_id))


def _write_manifest(spark: SparkSession, out: str, run_id: str, stages: Mapping[str, str]) -> None:
    lines = []
    for stage, folder in stages.items():
        files = [f for f in list_files(spark, folder) if f.name.endswith(".parquet")]
        # counted from the files' footers
        rows = spark.read.parquet(folder).count() if files else 0
        entry = {"run_id": run_id, "stage": stage, "files": len(files), "bytes": sum(f.length for f in files), "rows": rows}
        lines.append(json.dumps(entry))
    target, files = _place(spark, _manifest(out, run_id))
    written, _ = _place(spark, f"{_folder(out)}/written/{quote(run_id, safe='')}.json")
    stream = files.create(written, True)
    stream.write(bytearray("\n".join(lines).encode()))
    stream.close()
    files.mkdirs(target.getParent())
    if not files.rename(written, target):
        raise OSError(f"the manifest of run {run_id} can't be moved to {target}")


@contextmanager
def run_commit(spark: SparkSession, out: str, run_id: str) -> Iterator[dict[str, str]]:
    """Holds the run for one writer, who enters the folder of each stage into the dictionary.

    Without an error the manifest follows; with one the run stays without. A second writer of the same run
    gets ``RunConflict``, also after a writer was killed, until ``release``.
    """
    lock, files = _place(spark, _lock(out, run_id))
    if not files.createNewFile(lock):
        raise RunConflict(f"run {run_id} is being written; if its writer is gone, release it")
    try:
        _delete(spark, _manifest(out, run_id))
        stages: dict[str, str] = {}
        yield stages
        _write_manifest(spark, out, run_id, stages)
    finally:
        release(spark, out, run_id)


def manifests(spark: SparkSession, out: str) -> DataFrame:
    """``run_id, stage, files, bytes, rows`` of all complete runs."""
    if not exists(spark, f"{_folder(out)}/manifests/*.json"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{_folder(out)}/manifests/*.json")


def committed_runs(spark: SparkSession, out: str) -> set[str]:
    """Ids of complete runs, by the names of the manifests."""
    found = list_files(spark, f"{_folder(out)}/manifests/*.json")
    return {unquote(unquote(f.name.rsplit("/", 1)[-1].removesuffix(".json"))) for f in found}

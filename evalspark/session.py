"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a key that a record has twice counts as its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # prompts can be long; models take them in batches of tens anyway
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # a generated method past this size is never compiled by the JVM; smaller ones are
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "evalspark", **conf: str) -> SparkSession:
    """A session with the defaults above; keyword entries override them."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder, one for the
    session; on a cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="evalspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/evalspark/{name}-{uuid.uuid4().hex}"

"""Model responses written by an earlier generation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.json_values import strict_json
from evalspark.functions.text import is_blank
from evalspark.schema import RESPONSE_SCHEMA

RESPONSE_GLOB = "*_responses.jsonl"
RESPONSE_FIELDS = tuple(field.split()[0] for field in RESPONSE_SCHEMA.split(","))
RESPONSE_NAME = r"/([^/]+)_responses\.jsonl(?:/[^/]*)?$"


def dataset_of_file(path: Column) -> Column:
    """``math`` for ``…/math_responses.jsonl``, a file or a folder of part files."""
    return F.regexp_extract(path, RESPONSE_NAME, 1)


def undeclared_fields(value: Column) -> Column:
    """All other fields of a response as one VARIANT object, null if there are none."""
    fields = F.from_json(strict_json(value), "map<string,variant>")
    others = F.map_filter(fields, lambda name, _: ~name.isin(*RESPONSE_FIELDS))
    return F.when(F.size(others) > 0, F.try_parse_json(F.to_json(others, {"ignoreNullFields": "false"})))


def response_field(path: str, kind: str = "string") -> Column:
    """A field below ``fields``, such as ``metadata.level``; null where it is absent or of another kind."""
    return F.try_variant_get(F.col("fields"), f"$.{path}", kind)


def parse_responses(lines: DataFrame) -> DataFrame:
    """Typed responses from ``(value, file)``; ``error`` marks lines that are not JSON objects or have no id.

    A run without generation numbers has one response per sample, number 0. Fields that have no column
    of their own, such as ``metadata``, are in the VARIANT ``fields``.
    """
    parsed = lines.filter(~is_blank(F.col("value"))).select(
        "*",
        F.from_json(
            "value", f"{RESPONSE_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"}
        ).alias("r"),
    )
    rest = [c for c in lines.columns if c not in ("value", "file")]
    return parsed.select(
        F.coalesce("r.run_id", F.lit("")).alias("run_id"),
        F.coalesce("r.model", F.lit("unknown")).alias("model"),
        dataset_of_file(F.col("file")).alias("dataset"),
        "r.id",
        F.coalesce("r.generation_id", F.lit(0)).alias("generation_id"),
        "r.problem",
        "r.answer",
        "r.model_output",
        F.coalesce(F.col("r.tokens_used").cast("bigint"), F.lit(0).cast("bigint")).alias("tokens_used"),
        "r.finish_reason",
        undeclared_fields(F.col("value")).alias("fields"),
        "file",
        F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed JSON")
        .when(F.col("r.id").isNull(), "missing id")
        .alias("error"),
        F.col("value").alias("raw"),
        *rest,
    )


def load_responses(spark: SparkSession, results_dir: str) -> DataFrame:
    """All responses of a results folder in one scan."""
    lines = spark.read.text(f"{results_dir.rstrip('/')}/{RESPONSE_GLOB}").select(
        "value", F.col("_metadata.file_path").alias("file")
    )
    return parse_responses(lines)


def stream_responses(spark: SparkSession, results_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows as files arrive, with the file's time as ``arrived_at``."""
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(f"{results_dir.rstrip('/')}/{RESPONSE_GLOB}")
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("arrived_at"),
        )
    )
    return parse_responses(lines)

"""Files that Spark writes from the given tables, as input of the file queries.

Each source is a folder of part files in key order, written by as many tasks as there are
ranges. A set is written once per session and table folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.queries.registry import table
from evalspark.queries.views import RECORD_TEMPLATES, record_expression, turns
from evalspark.session import scratch_path
from evalspark.sinks.tables import save_jsonl

_WRITTEN: dict[tuple[str, str, str], str] = {}

DATASETS = tuple(name for name in RECORD_TEMPLATES if name not in ("generic", "checked"))

# a blank line before each key divisible by 5, as a second physical line
BLANK_EVERY = 5


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def write_ordered(df: DataFrame, key: str, line: Column, path: str) -> None:
    """Lines in key order over part files whose names follow the order."""
    (
        df.repartitionByRange(key)
        .sortWithinPartitions(key)
        .select(line.alias("value"))
        .write.text(path)
    )


def numbered_lines_dir(spark: SparkSession, sf_dir: str) -> str:
    """``orders/test.jsonl``: one JSON line per order, blank lines in between."""

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        record = F.to_json(F.struct("o_orderkey", "o_orderpriority"))
        blank = F.when(F.col("o_orderkey") % BLANK_EVERY == 0, F.lit(" \n")).otherwise(F.lit(""))
        write_ordered(orders, "o_orderkey", F.concat(blank, record), f"{path}/orders/test.jsonl")

    return _once(spark, sf_dir, "numbered", write)


def datasets_dir(spark: SparkSession, sf_dir: str) -> str:
    """``{dataset}/test.jsonl`` for every supported dataset, orders dealt out among them."""

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders")
        for i, name in enumerate(DATASETS):
            rows = orders.filter(F.col("o_orderkey") % len(DATASETS) == i)
            line = F.expr(record_expression(name))
            write_ordered(rows, "o_orderkey", line, f"{path}/{name}/test.jsonl")

    return _once(spark, sf_dir, "datasets", write)


def responses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the conversations as responses; the answer is the reply's first word."""
    word = F.element_at(F.split(F.trim("output"), " "), 1)
    wrong = F.col("turn") % 3 == 0
    return turns(spark, sf_dir).select(
        F.when(F.col("conv_id") % 3 == 0, "aa").when(F.col("conv_id") % 3 == 1, "bb").otherwise("cc").alias("dataset"),
        F.concat(F.col("conv_id"), F.lit("_"), F.col("turn")).alias("id"),
        F.lit(0).alias("generation_id"),
        "problem",
        F.when(wrong, F.lit("~no such word~")).otherwise(word).alias("answer"),
        F.concat(F.lit("thinking</think> "), F.col("output")).alias("model_output"),
        F.length("output").cast("bigint").alias("tokens_used"),
        F.lit("stop").alias("finish_reason"),
    )


RESPONSES_SQL = """responses AS (
  SELECT ['aa', 'bb', 'cc'][conv_id % 3 + 1] AS dataset, conv_id || '_' || turn AS id, problem,
         CASE WHEN turn % 3 = 0 THEN '~no such word~'
              ELSE list_extract(string_split(trim(output), ' '), 1) END AS answer,
         'thinking</think> ' || output AS model_output,
         CAST(length(output) AS BIGINT) AS tokens_used FROM turns)"""

RESPONSE_DATASETS = ("aa", "bb", "cc")


def responses_dir(spark: SparkSession, sf_dir: str) -> str:
    """``{dataset}_responses.jsonl`` folders; one of them is delivered twice. Two fields have no column."""

    def write(path: str) -> None:
        turn = F.substring_index("id", "_", -1).cast("int")
        more = F.struct((turn % 4).alias("level"), F.array(F.lit("t"), "id").alias("tags"))
        rows = responses_of(spark, sf_dir).withColumns({"metadata": more, "source": F.lit("chat")})
        for name in RESPONSE_DATASETS:
            part = rows.filter(F.col("dataset") == name).drop("dataset")
            save_jsonl(part, f"{path}/{name}_responses.jsonl")
        again = rows.filter(F.col("dataset") == "bb").drop("dataset")
        save_jsonl(again, f"{path}/bb_responses.jsonl", mode="append")

    return _once(spark, sf_dir, "responses", write)


ARRAY_SIZE = 500


def json_arrays_dir(spark: SparkSession, sf_dir: str) -> str:
    """Files with one JSON array of 500 judge records each."""

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders").select(
            F.floor(F.col("o_orderkey") / ARRAY_SIZE).alias("chunk"),
            "o_orderkey",
            F.concat(F.lit("Which order is "), "o_orderkey", F.lit("?")).alias("question"),
            F.concat(F.lit("It is "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("llm_output"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lit("none"))
            .otherwise(F.col("o_orderpriority"))
            .alias("correct_answer"),
        )
        record = F.struct("o_orderkey", "question", "llm_output", "correct_answer")
        arrays = orders.groupBy("chunk").agg(F.sort_array(F.collect_list(record)).alias("rows"))
        (
            arrays.select(F.to_json("rows").alias("value"))
            .write.option("maxRecordsPerFile", 1)
            .text(path)
        )

    return _once(spark, sf_dir, "arrays", write)


def one_array_file(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one file: all orders in key order as one JSON array, over several lines."""

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders").select("o_orderkey")
        tag = F.concat(F.lit('["'), "o_orderkey", F.lit('", {"a": "\\", ]"}]'))
        first, last = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
        line = F.concat(
            F.when(F.col("o_orderkey") == first, F.lit("[\n")).otherwise(F.lit("")),
            F.to_json(F.struct("o_orderkey", tag.alias("tag"))),
            F.when(F.col("o_orderkey") == last, F.lit("\n]")).otherwise(F.lit(" ,")),
        )
        # one task writes the one file, a stream of sorted rows
        orders.orderBy("o_orderkey").coalesce(1).sortWithinPartitions("o_orderkey").select(
            line.alias("value")
        ).write.text(path)

    return _once(spark, sf_dir, "one-array", write)

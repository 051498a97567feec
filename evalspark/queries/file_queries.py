"""Files, end-to-end jobs, model calls and streams."""

from __future__ import annotations

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.prompts import BOXED_INSTRUCTION
from evalspark.functions.text import clean_output
from evalspark.operators.inference import generate
from evalspark.operators.judging import judge, judge_inputs, verdicts_from_column
from evalspark.operators.keyed_joins import join_verdicts
from evalspark.operators.normalize import standardize
from evalspark.operators.quality import expected_file_check
from evalspark.plans.benchmark import BenchmarkSettings, run_benchmark
from evalspark.plans.comparison import compare_runs
from evalspark.plans.file_judge import judge_file
from evalspark.plans.migration import migrate, migrated_samples
from evalspark.plans.reevaluate import readable, reevaluate
from evalspark.plans.validation import simple_validate, validate
from evalspark.queries.file_data import (
    ARRAY_SIZE,
    BLANK_EVERY,
    DATASETS,
    RESPONSES_SQL,
    datasets_dir,
    json_arrays_dir,
    numbered_lines_dir,
    one_array_file,
    responses_dir,
    responses_of,
)
from evalspark.queries.metric_queries import rounded
from evalspark.queries.models import (
    make_containing_judge,
    make_echo_model,
    make_failing_judge,
    make_mixed_judge,
    make_rejecting_judge,
)
from evalspark.queries.registry import query, table
from evalspark.queries.sample_queries import NORMALIZED, normalize_sql
from evalspark.queries.text_queries import sql_clean, sql_literal
from evalspark.queries.views import TURNS_SQL, record_expression, with_views
from evalspark.schema import GenerationConfig
from evalspark.session import scratch_path
from evalspark.sinks.commits import manifests
from evalspark.sinks.tables import (
    read_run_table,
    register_runs,
    save_jsonl,
    write_run_table,
    write_text_lines,
)
from evalspark.sources.catalogue import (
    dataset_totals,
    file_inventory,
    split_catalogue,
)
from evalspark.sources.json_array import read_json_array, sample_json_array
from evalspark.sources.jsonl import read_jsonl, read_split
from evalspark.sources.responses import load_responses, response_field, stream_responses
from evalspark.streaming.history import KeyedHistory
from evalspark.streaming.incremental import (
    collapse_copies,
    drop_redelivered,
    evaluate_stream,
    metric_state,
    running_metrics,
    stream_metrics,
)

# --- line files -------------------------------------------------------------------------

_LINES_SQL = f"""lines AS (
  SELECT o_orderkey, o_orderpriority,
         o_orderkey + o_orderkey // {BLANK_EVERY} + 1 AS line_idx, o_orderkey AS rec_idx
  FROM orders)"""


def _numbered(spark: SparkSession, sf_dir: str, max_lines: int | None = None) -> DataFrame:
    root = numbered_lines_dir(spark, sf_dir)
    return read_split(spark, root, "orders", max_samples=max_lines).select(
        "dataset",
        "split",
        "line_idx",
        "rec_idx",
        F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
    )


@query(
    "line_index",
    with_views(
        "SELECT 'orders' AS dataset, 'test' AS split, line_idx, rec_idx, o_orderkey FROM lines",
        _LINES_SQL,
    ),
)
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and record numbers over all blocks and part files of a source."""
    return _numbered(spark, sf_dir)


@query(
    "first_lines",
    with_views("SELECT rec_idx, o_orderkey FROM lines WHERE line_idx < 1000", _LINES_SQL),
)
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's sample limit: physical lines, blank ones included."""
    return _numbered(spark, sf_dir, 1000).select("rec_idx", "o_orderkey")


@query(
    "jsonl_roundtrip",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text END AS text, lang, n_chars
       FROM documents""",
)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as JSON lines, nulls included, and read back."""
    path = f"{scratch_path(spark, 'roundtrip')}/documents/test.jsonl"
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("text"), "lang", "n_chars"
    )
    save_jsonl(rows, path)
    schema = "doc_id bigint, text string, lang string, n_chars bigint"
    return read_jsonl(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


@query(
    "json_array",
    f"""SELECT o_orderkey, o_orderkey % {ARRAY_SIZE} AS position,
               'Which order is ' || o_orderkey || '?' AS question FROM orders""",
)
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_json_array(spark, json_arrays_dir(spark, sf_dir))
    return rows.select("o_orderkey", "position", "question")


@query(
    "json_array_first",
    f"SELECT o_orderkey FROM orders WHERE o_orderkey % {ARRAY_SIZE} < 10",
)
def json_array_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten records of every array."""
    return read_json_array(spark, json_arrays_dir(spark, sf_dir), 10).select("o_orderkey")


@query(
    "json_array_sample",
    """SELECT o_orderkey, 'Which order is ' || o_orderkey || '?' AS question FROM orders
       ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 50""",
)
def json_array_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty records of all arrays, drawn by their order key."""
    arrays = json_arrays_dir(spark, sf_dir)
    rows = sample_json_array(spark, arrays, 50, seed=11, keys=["o_orderkey"])
    return rows.select("o_orderkey", "question")


@query(
    "json_array_blocks",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
              '["' || o_orderkey || '", {"a": "\\\", ]"}]' AS tag FROM orders""",
)
def json_array_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of all orders in one file, read in blocks of 64 KB."""
    schema = "o_orderkey bigint, tag string"
    path = one_array_file(spark, sf_dir)
    return read_json_array(spark, path, schema=schema, block_bytes=1 << 16).drop("file")


@query(
    "raw_lines_lenient",
    """SELECT o_orderkey::VARCHAR AS id, 'NaN or "Infinity"?' AS question,
              ['nan', 'inf', '-inf', '["nan",1]'][o_orderkey % 4 + 1] AS answer FROM orders""",
)
def raw_lines_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with numbers that JSON doesn't have, as Python's json module writes and reads them."""
    path = f"{scratch_path(spark, 'lenient')}/orders/test.jsonl"
    answers = F.array(*[F.lit(a) for a in ("NaN", "Infinity", "-Infinity", "[NaN, 1]")])
    answer = F.get(answers, (F.col("o_orderkey") % 4).cast("int"))
    line = F.format_string(
        '{"question": "NaN or \\"Infinity\\"?", "answer": %s, "id": %d}', answer, "o_orderkey"
    )
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    rows = standardize(read_jsonl(spark, path), keep=())
    return rows.where("error IS NULL").select("id", "question", "answer")


# --- folders of datasets ----------------------------------------------------------------


def _dataset_rows_sql(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, {columns.replace('<value>', record_expression(name))}"
        f" FROM orders WHERE o_orderkey % {len(DATASETS)} = {i}"
        for i, name in enumerate(DATASETS)
    )


_BYTES_SQL = "bytes AS (SELECT dataset, sum(b)::BIGINT AS bytes FROM ({}) GROUP BY dataset)".format(
    _dataset_rows_sql("strlen(<value>) + 1 AS b")
)


@query(
    "file_inventory",
    with_views(
        """SELECT dataset, 'test.jsonl' AS file, bytes,
                  format('{:.1f} KB', bytes / 1024) AS size FROM bytes""",
        _BYTES_SQL,
    ),
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_inventory(spark, datasets_dir(spark, sf_dir))


@query(
    "dataset_totals",
    with_views(
        """SELECT dataset, 1 AS n_files, bytes, format('{:.1f} KB', bytes / 1024) AS size
           FROM bytes""",
        _BYTES_SQL,
    ),
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_totals(file_inventory(spark, datasets_dir(spark, sf_dir)))


@query(
    "split_catalogue",
    """SELECT dataset, split, true AS declared,
              split = 'test' AND (SELECT count(*) FROM orders) > 9 AS found
       FROM (VALUES ('math', 'test'), ('math', 'train'), ('gsm8k', 'test'), ('gsm8k', 'train'),
         ('aime', 'test'), ('aime25', 'test'), ('olympiadbench', 'test'), ('mmlu-pro', 'test'),
         ('mmlu-pro', 'validation'), ('amc', 'test'), ('gpqa', 'test'), ('minerva', 'test'))
         d(dataset, split)""",
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_catalogue(spark, file_inventory(spark, datasets_dir(spark, sf_dir)))


@query(
    "expected_files",
    f"""SELECT dataset, count(o_orderkey) > 0 AS has_test_file
        FROM (VALUES {', '.join(f"('{name}', {i})" for i, name in enumerate(DATASETS))}, ('absent', -1)) d(dataset, i)
        LEFT JOIN orders ON o_orderkey % {len(DATASETS)} = i GROUP BY dataset""",
)
def expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which datasets of a folder, and one that isn't there, have a file of the expected name."""
    found = file_inventory(spark, datasets_dir(spark, sf_dir))
    asked = found.select("dataset").unionByName(spark.range(1).select(F.lit("absent").alias("dataset")))
    return expected_file_check(found, asked)


@query(
    "ordered_text",
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS line_idx,
              o_orderkey || ' ' || o_orderpriority AS value FROM orders""",
)
def ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in an order of their own, written as part files and numbered through by their names."""
    path = f"{scratch_path(spark, 'ordered')}/report/test.jsonl"
    rows = table(spark, sf_dir, "orders").select(
        (-F.col("o_totalprice")).alias("order"), "o_orderkey",
        F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("line"),
    )
    write_text_lines(rows, ["order", "o_orderkey"], "line", path)
    return read_jsonl(spark, path).select("line_idx", "value")


def _dealt_sql(name: str, index: int) -> str:
    """Expected readable samples of a dataset that holds every ninth order."""
    prefix, problem, answer, rule, _ = NORMALIZED[name]
    sql = normalize_sql(name, prefix, problem, answer, rule, {})
    count = len(DATASETS)
    sql = sql.replace("SELECT o_orderkey AS rec_idx", f"SELECT o_orderkey // {count} AS rec_idx")
    sql = sql.replace("AS value FROM orders", f"AS value FROM orders WHERE o_orderkey % {count} = {index}")
    return f"SELECT '{name}' AS dataset, id, problem, answer FROM ({sql}) WHERE error IS NULL"


_SAMPLES_SQL = "samples AS ({})".format(
    " UNION ALL ".join(_dealt_sql(name, i) for i, name in enumerate(DATASETS))
)


@query("migrate", with_views("SELECT * FROM samples", _SAMPLES_SQL))
def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw files converted to one table, read back."""
    target = scratch_path(spark, "migrated")
    migrate(spark, datasets_dir(spark, sf_dir), target)
    return migrated_samples(spark, target).select("dataset", "id", "problem", "answer")


@query(
    "migrate_dry_run",
    with_views(
        """SELECT dataset, 'would migrate' AS status, count(*) AS rows FROM samples
           WHERE dataset IN ('math', 'amc') GROUP BY dataset
           UNION ALL SELECT 'nope', 'missing', NULL""",
        _SAMPLES_SQL,
    ),
)
def migrate_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = migrate(
        spark,
        datasets_dir(spark, sf_dir),
        scratch_path(spark, "dry"),
        requested=["math", "amc", "nope"],
        dry_run=True,
    )
    return counts.drop("unreadable")


# the raw check fails a file whose first problem or answer is missing or empty
_VALIDATION_SQL = (
    "raw AS (SELECT dataset, line, value FROM ({}))".format(
        _dataset_rows_sql(f"o_orderkey // {len(DATASETS)} AS line, <value> AS value")
    ),
    """rows AS (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM raw)""",
    """files AS (
      SELECT dataset, bool_and(j IS NOT NULL AND json_type(j, '$.problem') IS NOT NULL
        AND json_type(j, '$.answer') IS NOT NULL AND coalesce(j ->> '$.problem', '') <> ''
        AND coalesce(j ->> '$.answer', '') NOT IN ('', '0', 'false', '0.0')) AS file_ok
      FROM rows GROUP BY dataset)""",
    """loads AS (
      SELECT dataset, CASE dataset
        WHEN 'math' THEN bool_and(j IS NOT NULL AND json_type(j, '$.solution') IN ('VARCHAR')
                                  OR json_type(j, '$.solution') IS NULL AND j IS NOT NULL)
        WHEN 'olympiadbench' THEN bool_and(coalesce(json_type(j, '$.answer'), '') <> 'ARRAY')
        WHEN 'minerva' THEN bool_and(coalesce(json_type(j, '$.answer'), '') <> 'UBIGINT'
                                     OR j ->> '$.answer' = '0')
        ELSE true END AS loader_ok FROM rows GROUP BY dataset)""",
)


@query(
    "capped_datasets",
    with_views(
        "SELECT dataset, line_idx, line_idx AS rec_idx, value FROM raw WHERE line_idx < 20",
        "raw AS ({})".format(
            _dataset_rows_sql(f"o_orderkey // {len(DATASETS)} AS line_idx, <value> AS value")
        ),
    ),
)
def capped_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty lines of every dataset, read as prefixes of their files."""
    rows = read_split(spark, datasets_dir(spark, sf_dir), DATASETS, max_samples=20)
    return rows.select("dataset", "line_idx", "rec_idx", "value")


@query(
    "kept_line_index",
    with_views("SELECT line_idx, rec_idx, o_orderkey FROM lines", _LINES_SQL),
)
def kept_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all lines from the block counts that an earlier read has kept."""
    root, index = numbered_lines_dir(spark, sf_dir), scratch_path(spark, "line-index")
    read_split(spark, root, "orders", index_dir=index)
    key = F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey")
    return read_split(spark, root, "orders", index_dir=index).select("line_idx", "rec_idx", key)


@query(
    "validate",
    with_views(
        """SELECT dataset, file_ok, loader_ok, file_ok AND loader_ok AS valid
           FROM files JOIN loads USING (dataset)""",
        *_VALIDATION_SQL,
    ),
)
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines are checked, not only the first five."""
    return validate(spark, datasets_dir(spark, sf_dir), max_samples=None)["datasets"]


@query(
    "simple_validate",
    with_views("SELECT dataset, file_ok AS valid FROM files", *_VALIDATION_SQL),
)
def simply_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_validate(spark, datasets_dir(spark, sf_dir), max_samples=None)


# --- model calls ------------------------------------------------------------------------


@query(
    "generate",
    """SELECT conv_id, turn, g AS generation_id,
              g || ': ' || CASE g % 2 WHEN 0 THEN text ELSE left(text, 10) END AS model_output,
              CAST(CASE g % 2 WHEN 0 THEN length(text) ELSE 10 END AS BIGINT) AS tokens_used,
              CASE WHEN g % 2 = 0 AND length(text) >= 300 THEN 'length'
                   WHEN g % 2 = 1 THEN 'eos' ELSE 'stop' END AS finish_reason
       FROM conversations, range(3) gs(g)""",
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    config = GenerationConfig(n=3, max_tokens=300)
    return generate(rows, make_echo_model, config, "text").drop("text")


_JUDGED_SQL = f"""judged AS (
  SELECT *, contains({sql_clean('model_output')}, answer) AS is_correct FROM responses)"""


@query(
    "judge_batch",
    with_views(
        """SELECT dataset, id, is_correct,
                  CASE WHEN is_correct THEN '[Correct]' ELSE '[Incorrect]' END
                    AS evaluation_reasoning
           FROM judged""",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def judge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(responses_of(spark, sf_dir), make_containing_judge)
    return judged.select("dataset", "id", "is_correct", "evaluation_reasoning")


@query(
    "judge_resumed",
    with_views(
        """SELECT dataset, id, generation_id, is_correct AND split_part(id, '_', 1)::BIGINT % 2 = 0 AS is_correct
           FROM judged, range(2) g(generation_id)""",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def judge_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of all responses, each there twice, calls its judge, who rejects all, for what the first left out."""
    store = scratch_path(spark, "judge-calls")
    responses = responses_of(spark, sf_dir)
    even = F.substring_index("id", "_", 1).cast("bigint") % 2 == 0
    judge(responses.where(even), make_containing_judge, store=store, judge_name="j")
    twice = responses.withColumn("generation_id", F.explode(F.array(F.lit(0), F.lit(1))))
    judged = judge(twice, make_rejecting_judge, store=store, judge_name="j", partitions=16)
    return judged.select("dataset", "id", F.col("generation_id").cast("bigint"), "is_correct")


@query(
    "judge_inputs",
    with_views(
        "SELECT problem AS question, model_output, answer AS correct_answer, id FROM responses",
        TURNS_SQL,
        RESPONSES_SQL,
    ),
)
def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_inputs(responses_of(spark, sf_dir))


@query(
    "join_verdicts",
    with_views(
        "SELECT dataset, id, problem, is_correct, tokens_used FROM judged WHERE is_correct",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def joined_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses joined to a verdict table that holds the correct ones only."""
    responses = responses_of(spark, sf_dir)
    right = F.contains(clean_output(F.col("model_output")), F.col("answer"))
    given = responses.withColumn("text", F.when(right, "Correct").otherwise("Incorrect"))
    verdicts = verdicts_from_column(given, "text", "exact").filter("is_correct")
    keys = ("dataset", "id", "generation_id")
    joined = join_verdicts(responses, verdicts.select(*keys, "is_correct"), keys)
    return joined.select("dataset", "id", "problem", "is_correct", "tokens_used")


@query(
    "judge_file",
    """SELECT 'mixed' AS judge, valid_num, correct_num, valid_num - correct_num AS incorrect_num,
              correct_num / n AS accuracy, n AS results_num, n AS data_num
       FROM (SELECT count(*) FILTER (o_orderkey % 10 <> 7) AS valid_num,
                    count(*) FILTER (o_orderkey % 10 <> 7 AND o_orderkey % 4 <> 0) AS correct_num,
                    count(*) AS n FROM orders)""",
)
def judged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of a judged file; bracketed labels are not valid in its statistics."""
    out = scratch_path(spark, "judge-file")
    arrays = json_arrays_dir(spark, sf_dir)
    statistics = judge_file(spark, arrays, out, make_mixed_judge, "mixed", "run", partitions=64)
    results = spark.read.parquet(f"{out}/results/run_id=run")
    counted = results.groupBy("judge").agg(F.count("judgment").alias("results_num"))
    info = spark.read.parquet(f"{out}/info/run_id=run").select(
        F.col("model_name").alias("judge"), "data_num"
    )
    return statistics.join(counted, "judge").join(info, "judge")


@query(
    "runs_table",
    """SELECT 'run ' || strftime(o_orderdate, '%Y-%m') AS run_id, 'org/model-' || max(o_orderkey) AS model_path,
              'model-' || max(o_orderkey) AS model, max(o_orderkey)::VARCHAR AS seed, count(*) > 1 AS replaced
       FROM orders GROUP BY 1""",
)
def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each month of orders: its first order registered, then all others; the last one counts."""
    path = scratch_path(spark, "runs")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(
        F.concat(F.lit("run "), F.date_format("o_orderdate", "yyyy-MM")).alias("run_id"),
        F.concat(F.lit("org/model-"), key).alias("model_path"),
        F.create_map(F.lit("seed"), key.cast("string")).alias("config"),
        F.timestamp_seconds(key).alias("started_at"),
    )
    first = rows.groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    before = rows.join(first, ["run_id", "started_at"])
    register_runs(before, path)
    register_runs(rows.join(before, ["run_id", "started_at"], "left_anti"), path)
    later = rows.groupBy("run_id").agg((F.count(F.lit(1)) > 1).alias("replaced"))
    runs = read_run_table(spark, path).join(later, "run_id")
    return runs.select(
        "run_id", "model_path", "model", F.col("config")["seed"].alias("seed"), "replaced"
    )


@query(
    "run_rewritten",
    "SELECT o_orderkey, o_orderpriority AS dataset FROM orders WHERE o_orderpriority < '3'",
)
def run_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written again with fewer datasets holds no rows of those that are gone."""
    path = scratch_path(spark, "rewritten")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("dataset")
    )
    write_run_table(rows, path, "1")
    write_run_table(rows.filter(F.col("dataset") < "3"), path, "1")
    return read_run_table(spark, path, "1").select("o_orderkey", "dataset")


@query(
    "migrate_overwrite",
    """SELECT 'gsm8k' AS dataset, 'test' AS split, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0
       UNION ALL SELECT 'amc', 'train', count(*) FROM orders WHERE o_orderkey % 2 = 1""",
)
def migrate_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that has left the source leaves the table when its dataset is migrated again."""
    base = scratch_path(spark, "resplit")
    orders = table(spark, sf_dir, "orders")
    record = F.to_json(F.struct(F.lit("q").alias("question"), F.col("o_orderkey").cast("string").alias("answer")))
    halves = {"gsm8k/test": 0, "gsm8k/train": 1, "amc/train": 1}
    for root, names in (("first", halves), ("second", {"gsm8k/test": 0})):
        for name in names:
            half = orders.filter(F.col("o_orderkey") % 2 == halves[name])
            half.select(record.alias("value")).write.text(f"{base}/{root}/{name}.jsonl")
    migrate(spark, f"{base}/first", f"{base}/table").collect()
    migrate(spark, f"{base}/second", f"{base}/table", overwrite=True).collect()
    return spark.read.parquet(f"{base}/table").groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- end-to-end jobs --------------------------------------------------------------------


def _metric_columns(df: DataFrame) -> DataFrame:
    got = df.select(
        "dataset",
        "total_samples",
        "correct_samples",
        "accuracy",
        "pass_at_1",
        "pass_at_3",
        "total_tokens",
        "avg_tokens_per_correct",
        "problem_count",
    )
    return rounded(got, "accuracy", "pass_at_1", "pass_at_3", "avg_tokens_per_correct")


def _run_metrics_sql(rows: str) -> str:
    """Metrics of one attempt per sample: pass@1 is the accuracy, pass@3 has no problem."""
    return f"""SELECT dataset, count(*) AS total_samples,
      count(*) FILTER (is_correct) AS correct_samples,
      round(avg(CAST(is_correct AS INT)), 9) AS accuracy,
      round(avg(CAST(is_correct AS INT)), 9) AS pass_at_1, 0.0::DOUBLE AS pass_at_3,
      sum(tokens_used)::BIGINT AS total_tokens,
      round(coalesce(avg(tokens_used) FILTER (is_correct), 0.0), 9) AS avg_tokens_per_correct,
      count(*) AS problem_count FROM {rows} GROUP BY dataset"""


_ECHO_SQL = """echoed AS (
  SELECT dataset, contains('0: ' || coalesce(problem, 'None'), coalesce(answer, 'None'))
           AS is_correct_text,
         length(coalesce(problem, 'None')) + {n} AS tokens_used, coalesce(answer, 'None') AS answer,
         '0: ' || coalesce(problem, 'None') || chr(10) || chr(10) || {boxed} AS output FROM samples),
run AS (SELECT dataset, contains({clean}, answer) AS is_correct, tokens_used FROM echoed)"""


def _echo_sql() -> str:
    return _ECHO_SQL.format(
        n=len(BOXED_INSTRUCTION) + 2, boxed=sql_literal(BOXED_INSTRUCTION), clean=sql_clean("output")
    )


def _benchmark_settings(spark: SparkSession, sf_dir: str, **changes) -> BenchmarkSettings:
    values = {
        "data_dir": datasets_dir(spark, sf_dir),
        "datasets": DATASETS,
        "out_dir": scratch_path(spark, "benchmark"),
        "model_path": "models/echo",
        "run_id": "run1",
    }
    return BenchmarkSettings(**{**values, **changes})


@query(
    "benchmark_run",
    with_views(_run_metrics_sql("run"), _SAMPLES_SQL, _echo_sql()),
)
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, generate, judge and measure every dataset as one job."""
    settings = _benchmark_settings(spark, sf_dir)
    return _metric_columns(
        run_benchmark(spark, settings, make_echo_model, make_containing_judge)
    )


@query(
    "small_run",
    with_views(
        _run_metrics_sql("(SELECT * FROM run WHERE dataset IN ('math', 'gsm8k'))"),
        _SAMPLES_SQL,
        _echo_sql(),
    ),
)
def small_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets, pass@1 and pass@3 only."""
    settings = _benchmark_settings(
        spark,
        sf_dir,
        datasets=("math", "gsm8k"),
        ks=(1, 3),
        system_prompt="You are a helpful assistant that solves problems step by step.",
    )
    return _metric_columns(
        run_benchmark(spark, settings, make_echo_model, make_containing_judge)
    )


@query(
    "dataset_info",
    with_views(
        """SELECT dataset, dataset AS name, count(*) AS total_samples, 'echo' AS model,
                  'models/echo' AS model_path, true AS stamped
           FROM run WHERE dataset IN ('math', 'gsm8k') GROUP BY dataset""",
        _SAMPLES_SQL,
        _echo_sql(),
    ),
)
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metrics documents that a run writes say of the run."""
    settings = _benchmark_settings(spark, sf_dir, datasets=("math", "gsm8k"))
    run_benchmark(spark, settings, make_echo_model, make_containing_judge)
    lines = spark.read.text(f"{settings.out_dir}/summary/run_id=run1")
    written = F.from_json("value", "dataset string, document string").alias("w")
    info = "struct<name: string, total_samples: bigint, model: string, model_path: string, evaluation_timestamp: string>"
    rows = lines.select(written).select(
        "w.dataset", F.from_json("w.document", f"dataset_info {info}")["dataset_info"].alias("i")
    )
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$"
    return rows.select(
        "dataset", "i.name", "i.total_samples", "i.model", "i.model_path",
        F.col("i.evaluation_timestamp").rlike(stamp).alias("stamped"),
    )


@query(
    "compare_runs",
    with_views(
        """SELECT dataset, model, accuracy, total_samples FROM (SELECT DISTINCT dataset FROM run)
           CROSS JOIN (VALUES ('echo'), ('other'), ('absent')) m(model)
           LEFT JOIN (
             SELECT dataset, model, round(avg(CAST(is_correct AS INT)), 9) AS accuracy,
                    count(*) AS total_samples
             FROM run CROSS JOIN (VALUES ('echo'), ('other')) n(model)
             WHERE model = 'echo' OR dataset = 'math' GROUP BY ALL) USING (dataset, model)
           WHERE dataset IN ('math', 'gsm8k')""",
        _SAMPLES_SQL,
        _echo_sql(),
    ),
)
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in one folder, the second without one of the datasets."""
    first = _benchmark_settings(spark, sf_dir, datasets=("math", "gsm8k"))
    second = _benchmark_settings(
        spark, sf_dir, datasets=("math",), model_path="models/other", run_id="run2",
        out_dir=first.out_dir,
    )
    for settings in (first, second):
        run_benchmark(spark, settings, make_echo_model, make_containing_judge)
    grid = compare_runs(
        spark,
        f"{first.out_dir}/metrics",
        ("run1", "run2"),
        ("echo", "other", "absent"),
        f"{first.out_dir}/comparison",
    )
    return rounded(grid.select("dataset", "model", "accuracy", "total_samples"), "accuracy")


@query(
    "committed_runs",
    with_views(
        """SELECT run_id, stage, rows FROM (VALUES ('run1'), ('run2')) r(run_id) CROSS JOIN (
             SELECT 'samples' AS stage, (SELECT count(*) FROM orders WHERE o_orderkey % 9 IN (0, 1)) AS rows
             UNION ALL SELECT 'responses', (SELECT count(*) FROM run WHERE dataset IN ('math', 'gsm8k'))
             UNION ALL SELECT 'results', (SELECT count(*) FROM run WHERE dataset IN ('math', 'gsm8k'))
             UNION ALL SELECT 'metrics', 2) WHERE run_id <> 'run2'""",
        _SAMPLES_SQL,
        _echo_sql(),
    ),
)
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests after one run that is complete and one whose judge failed."""
    first = _benchmark_settings(spark, sf_dir, datasets=("math", "gsm8k"))
    run_benchmark(spark, first, make_echo_model, make_containing_judge)
    try:
        broken = _benchmark_settings(
            spark, sf_dir, datasets=("math",), run_id="run2", out_dir=first.out_dir
        )
        run_benchmark(spark, broken, make_echo_model, make_failing_judge)
    except PythonException:
        pass
    return manifests(spark, first.out_dir).select("run_id", "stage", "rows")


@query(
    "load_responses",
    with_views(
        """SELECT dataset, id, problem, answer, model_output, tokens_used FROM responses
           UNION ALL
           SELECT dataset, id, problem, answer, model_output, tokens_used FROM responses
           WHERE dataset = 'bb'""",
        TURNS_SQL,
        RESPONSES_SQL,
    ),
)
def loaded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readable(load_responses(spark, responses_dir(spark, sf_dir)))
    return rows.select("dataset", "id", "problem", "answer", "model_output", "tokens_used")


@query(
    "reevaluate",
    with_views(
        """SELECT dataset, total_samples, accuracy, problem_count FROM (
             SELECT dataset, count(*) AS total_samples,
                    round(avg(CAST(is_correct AS INT)), 9) AS accuracy, count(*) AS problem_count
             FROM judged GROUP BY dataset)""",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def reevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch re-evaluation counts a response once, however often it was delivered."""
    metrics = reevaluate(
        spark,
        responses_dir(spark, sf_dir),
        scratch_path(spark, "reevaluated"),
        lambda responses: judge(responses, make_containing_judge),
        "again",
    )
    return rounded(
        metrics.select("dataset", "total_samples", "accuracy", "problem_count"), "accuracy"
    )


@query(
    "response_fields",
    with_views(
        """SELECT dataset, id, 'chat' AS source, split_part(id, '_', 2)::INT % 4 AS level,
                  '["t","' || id || '"]' AS tags FROM responses""",
        TURNS_SQL,
        RESPONSES_SQL,
    ),
)
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that have no column of their own, from the results that a re-evaluation has written."""
    out = scratch_path(spark, "fields")
    reevaluate(
        spark,
        responses_dir(spark, sf_dir),
        out,
        lambda responses: judge(responses, make_containing_judge),
        "fields",
    )
    return read_run_table(spark, f"{out}/results", "fields").select(
        "dataset",
        "id",
        response_field("source").alias("source"),
        response_field("metadata.level", "int").alias("level"),
        F.to_json(response_field("metadata.tags", "variant")).alias("tags"),
    )


@query(
    "reevaluate_by_field",
    with_views(
        """SELECT dataset, attribute, value, count(*) AS total_samples,
                  round(avg(CAST(is_correct AS INT)), 9) AS accuracy, count(*) AS problem_count
           FROM (SELECT *, 'level' AS attribute, (split_part(id, '_', 2)::INT % 4)::VARCHAR AS value FROM judged
                 UNION ALL SELECT *, 'source', 'chat' FROM judged)
           GROUP BY dataset, attribute, value""",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def reevaluated_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a re-evaluation by two of the responses' own fields."""
    out = scratch_path(spark, "by-field")
    reevaluate(
        spark,
        responses_dir(spark, sf_dir),
        out,
        lambda responses: judge(responses, make_containing_judge),
        "fields",
        attributes={"level": "metadata.level", "source": "source"},
    )
    table_ = read_run_table(spark, f"{out}/attributes", "fields")
    columns = ("dataset", "attribute", "value", "total_samples", "accuracy", "problem_count")
    return rounded(table_.select(*columns), "accuracy")


# --- streams ----------------------------------------------------------------------------


def _run_stream(spark: SparkSession, sf_dir: str, keep_state: bool = False) -> str:
    out = scratch_path(spark, "stream")
    stream = evaluate_stream(
        spark,
        responses_dir(spark, sf_dir),
        out,
        lambda responses: judge(responses, make_containing_judge),
        f"{out}/checkpoint",
        files_per_trigger=4,
        keep_state=keep_state,
    )
    stream.awaitTermination()
    return out


@query(
    "stream_eval",
    with_views(
        "SELECT dataset, id, is_correct, tokens_used FROM judged",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def stream_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving files judged once per response, re-deliveries dropped."""
    verdicts = spark.read.parquet(f"{_run_stream(spark, sf_dir)}/verdicts")
    return verdicts.select("dataset", "id", "is_correct", "tokens_used")


@query(
    "stream_metrics",
    with_views(_run_metrics_sql("judged"), TURNS_SQL, RESPONSES_SQL, _JUDGED_SQL),
)
def metrics_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_columns(stream_metrics(spark, _run_stream(spark, sf_dir)))


@query(
    "stream_state",
    with_views(_run_metrics_sql("judged"), TURNS_SQL, RESPONSES_SQL, _JUDGED_SQL),
)
def state_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that the stream's state has taken in batch by batch."""
    return _metric_columns(metric_state(spark, _run_stream(spark, sf_dir, keep_state=True)).metrics())


@query(
    "keyed_history",
    """SELECT o_orderkey::VARCHAR AS id, batch_id, batch_id * 1000000 + o_custkey AS n FROM (
         SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 4 = 0 THEN 2
                        WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 0 END AS batch_id
         FROM orders WHERE o_orderkey % 7 < 3) WHERE batch_id IS NOT NULL""",
)
def history_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches with keys in common; the latest row of each key asked for."""
    history = KeyedHistory(
        spark, scratch_path(spark, "history"), ["id"], "id string, batch bigint, n bigint"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey").cast("string").alias("id")
    for batch in range(4):
        rows = orders.where(F.col("o_orderkey") % (batch + 2) == 0)
        value = F.col("o_custkey") + batch * 1_000_000
        history.add(rows.select(key, F.lit(batch).alias("batch"), value.alias("n")), batch)
    wanted = orders.where(F.col("o_orderkey") % 7 < 3).select(key)
    return history.latest(wanted).select("id", F.col("batch").cast("int").alias("batch_id"), "n")


@query(
    "running_metrics",
    with_views(
        """SELECT dataset, count(*) AS total_samples,
                  count(*) FILTER (is_correct) AS correct_samples,
                  round(avg(CAST(is_correct AS INT)), 9) AS accuracy,
                  sum(tokens_used)::BIGINT AS total_tokens
           FROM judged GROUP BY dataset""",
        TURNS_SQL,
        RESPONSES_SQL,
        _JUDGED_SQL,
    ),
)
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete-mode aggregate over the stream, as last emitted."""
    out = scratch_path(spark, "running")
    responses = stream_responses(spark, responses_dir(spark, sf_dir))
    good = drop_redelivered(responses.filter(F.col("error").isNull())).drop("error", "raw", "file")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/metrics")

    stream = (
        running_metrics(judge(good, make_containing_judge))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    stream.awaitTermination()
    got = spark.read.parquet(f"{out}/metrics").drop("token_efficiency")
    return rounded(got, "accuracy")


@query(
    "drop_redelivered",
    with_views("SELECT dataset, id FROM responses", TURNS_SQL, RESPONSES_SQL),
)
def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarked deduplication with bounded state."""
    out = scratch_path(spark, "redelivered")
    rows = drop_redelivered(stream_responses(spark, responses_dir(spark, sf_dir)))
    stream = (
        rows.select("dataset", "id")
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    "collapse_copies",
    with_views("SELECT dataset, id, tokens_used FROM responses", TURNS_SQL, RESPONSES_SQL),
)
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch deduplication of deliveries, folded in each task before the shuffle."""
    rows = load_responses(spark, responses_dir(spark, sf_dir)).withColumn(
        "arrived_at", F.lit(None).cast("timestamp")
    )
    return collapse_copies(rows).select("dataset", "id", "tokens_used")


@query(
    "run_table",
    with_views("SELECT dataset, id, '007' AS run_id FROM responses", TURNS_SQL, RESPONSES_SQL),
)
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table written twice under one run id and once under another."""
    path = scratch_path(spark, "run-table")
    rows = responses_of(spark, sf_dir)
    for run_id in ("007", "7", "007"):
        write_run_table(rows.withColumn("run_id", F.lit(run_id)), path, run_id)
    return read_run_table(spark, path, "007").select("dataset", "id", "run_id")

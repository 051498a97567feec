"""Normalisers, quality checks and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.normalize import (
    good_samples,
    normalize,
    quarantine,
    standardize,
)
from evalspark.operators.quality import (
    complete_samples,
    dataset_verdict,
    file_verdict,
    has_fields,
    loader_check,
    raw_check,
    requested_datasets,
    validation_totals,
)
from evalspark.operators.sampling import sample_n
from evalspark.queries.registry import query, table
from evalspark.queries.text_queries import sql_extract
from evalspark.queries.views import records, records_sql, sql_strip, with_views

# --- JSON values in the oracle's SQL ----------------------------------------------------


def sql_first(*names: str, default: str = '""') -> str:
    """First field that exists, even if null."""
    branches = " ".join(
        f"WHEN json_type(j, '$.{name}') IS NOT NULL THEN json_extract(j, '$.{name}')"
        for name in names
    )
    return f"CASE {branches} ELSE CAST('{default}' AS JSON) END"


def sql_value_text(json: str, null_text: str) -> str:
    return (
        f"CASE json_type({json}) WHEN 'NULL' THEN {null_text} WHEN 'BOOLEAN' THEN"
        f" CASE {json} ->> '$' WHEN 'true' THEN 'True' ELSE 'False' END ELSE {json} ->> '$' END"
    )


def sql_truthy(json: str) -> str:
    """NULL stands for absent."""
    return f"""coalesce(CASE json_type({json}) WHEN 'NULL' THEN false
      WHEN 'VARCHAR' THEN {json} ->> '$' <> '' WHEN 'BOOLEAN' THEN {json} ->> '$' = 'true'
      WHEN 'ARRAY' THEN json_array_length({json}) > 0 WHEN 'OBJECT' THEN len(json_keys({json})) > 0
      ELSE CAST({json} ->> '$' AS DOUBLE) <> 0 END, false)"""


_PARSED = "parsed AS (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM records)"
_IS_TEXT = "json_type(a) = 'VARCHAR'"


def _answer_sql(rule: str) -> str:
    if rule == "raw":
        return sql_value_text("a", "NULL")
    if rule == "str":
        return sql_value_text("a", "'None'")
    if rule == "gsm8k":
        return (
            f"CASE WHEN {_IS_TEXT} THEN {sql_extract('atext', rule)}"
            f" ELSE {sql_value_text('a', chr(39) + 'None' + chr(39))} END"
        )
    return sql_extract("atext", rule)


def _error_sql(rule: str) -> str:
    bad = {
        "math": f"NOT {_IS_TEXT}",
        "minerva": f"NOT {_IS_TEXT} AND {sql_truthy('a')}",
        "olympiad": f"NOT {_IS_TEXT} AND {sql_truthy('a')}",
    }.get(rule, "false")
    return f"CASE WHEN j IS NULL THEN 'malformed JSON' WHEN {bad} THEN 'answer is not text' END"


def normalize_sql(
    kind: str, prefix: str, problem: str, answer: str, rule: str, metadata: dict[str, str]
) -> str:
    """Expected samples of one dataset; ``metadata`` maps a column to its SQL."""
    fields = (
        f"fields AS (SELECT *, {problem} AS problem, {answer} AS a FROM parsed)",
        "texts AS (SELECT *, CASE WHEN json_type(a) = 'VARCHAR' THEN a ->> '$' ELSE '' END AS atext"
        " FROM fields)",
        f"checked AS (SELECT *, {_error_sql(rule)} AS error FROM texts)",
    )
    extra = "".join(
        f", CASE WHEN error IS NULL THEN {sql} END AS {name}" for name, sql in metadata.items()
    )
    return with_views(
        f"""SELECT '{prefix}_test_' || rec_idx AS id, error,
                   CASE WHEN error IS NULL THEN problem END AS problem,
                   CASE WHEN error IS NULL THEN {_answer_sql(rule)} END AS answer{extra}
            FROM checked""",
        records_sql(kind),
        _PARSED,
        *fields,
    )


def _text_field(*names: str, default: str = '""') -> str:
    return f"({sql_first(*names, default=default)}) ->> '$'"


def _plain_problem(*names: str) -> str:
    return sql_value_text(f"({sql_first(*names)})", "NULL")


_CHOICES = sql_first("options", "choices", default="[]")
_MMLU_PROBLEM = f"""CASE WHEN json_array_length({_CHOICES}) > 0 THEN {sql_strip(
    "(" + _text_field("question", "problem") + ") || chr(10) || chr(10) || 'Options:' || chr(10) || "
    f"'A. ' || (({_CHOICES}) ->> '$[0]') || chr(10) || 'B. ' || (({_CHOICES}) ->> '$[1]') || chr(10)"
    " || 'C. 27.0' || chr(10) || 'D. True' || chr(10) || 'E. None' || chr(10)"
)} ELSE {_plain_problem("question", "problem")} END"""

# dataset: prefix, problem, answer field, rule, metadata columns
NORMALIZED = {
    "math": ("math", _plain_problem("problem"), sql_first("solution"), "math",
             {"level": _text_field("level"), "type": _text_field("type")}),
    "gsm8k": ("gsm8k", _plain_problem("question", "problem"), sql_first("answer"), "gsm8k",
              {"raw_answer": _text_field("answer")}),
    "aime": ("aime", _plain_problem("problem", "question"), sql_first("answer"), "str",
             {"year": _text_field("year"), "contest": _text_field("contest")}),
    "aime25": ("aime25", _plain_problem("problem", "question"), sql_first("answer"), "str",
               {"year": _text_field("year"), "contest": _text_field("contest")}),
    "olympiadbench": ("olympiadbench", _plain_problem("problem", "question"),
                      sql_first("answer", "solution"), "olympiad",
                      {"subject": _text_field("subject"), "year": _text_field("year"),
                       "country": _text_field("country")}),
    "mmlu-pro": ("mmlu_pro", _MMLU_PROBLEM, sql_first("answer"), "raw",
                 {"category": _text_field("category", "subject"),
                  "answer_index": _text_field("answer_index", default="-1")}),
    "amc": ("amc", _plain_problem("problem", "question"), sql_first("answer"), "str",
            {"year": _text_field("year"), "problem_number": _text_field("problem_number")}),
    "gpqa": ("gpqa", _plain_problem("question", "problem"), sql_first("correct_answer", "answer"),
             "raw", {"domain": _text_field("domain"), "explanation": _text_field("explanation")}),
    "minerva": ("minerva", _plain_problem("problem", "question"), sql_first("answer", "solution"),
                "minerva", {"level": _text_field("level"), "raw_answer": _text_field("answer")}),
}


def _register_normalizer(dataset: str) -> None:
    prefix, problem, answer, rule, metadata = NORMALIZED[dataset]
    sql = normalize_sql(dataset, prefix, problem, answer, rule, metadata)

    @query("normalize_" + dataset.replace("-", "_"), sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = normalize(records(spark, sf_dir, dataset), dataset)
        good = F.col("error").isNull()
        return rows.select(
            "id",
            "error",
            *[F.when(good, F.col(c)).alias(c) for c in ("problem", "answer")],
            *[
                F.when(good, F.try_variant_get("metadata", f"$.{key}", "string")).alias(key)
                for key in metadata
            ],
        )


for _dataset in NORMALIZED:
    _register_normalizer(_dataset)


_BAD_MATH = "o_orderkey % 6 IN (4, 5)"


@query(
    "quarantine",
    f"""SELECT 'math_test_' || o_orderkey AS id,
               CASE o_orderkey % 6 WHEN 4 THEN 'answer is not text' ELSE 'malformed JSON' END AS error
        FROM orders WHERE {_BAD_MATH}""",
)
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(normalize(records(spark, sf_dir, "math"), "math")).select("id", "error")


@query(
    "strict_samples",
    """SELECT 'gsm8k' AS dataset, count(*) AS n FROM orders""",
)
def strict_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with one unreadable record is dropped whole, the other stays."""
    both = normalize(records(spark, sf_dir, "math"), "math").unionByName(
        normalize(records(spark, sf_dir, "gsm8k"), "gsm8k")
    )
    return good_samples(both, strict=True).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


_GENERIC = {
    "question": ("question", "problem", "input", "query"),
    "answer": ("answer", "solution", "target", "output"),
    "id": ("id", "idx", "index", "problem_id"),
}


@query(
    "standardize",
    with_views(
        "SELECT rec_idx, 'generic' AS dataset, "
        + ", ".join(
            sql_value_text(f"({sql_first(*names)})", "NULL") + f" AS {standard}"
            for standard, names in _GENERIC.items()
        )
        + """, j ->> '$.tag' AS tag, j ->> '$.score' AS score, j ->> '$.tags' AS tags,
             j ->> '$.other' AS other, j ->> '$.n' AS n,
             len(list_filter(json_keys(j), lambda k: k IN ('tag', 'score', 'tags', 'other', 'n')))
               AS n_metadata
           FROM parsed""",
        records_sql("generic"),
        _PARSED,
    ),
)
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standardize(records(spark, sf_dir, "generic"), keep=("rec_idx", "dataset"))
    return rows.select(
        "rec_idx",
        "dataset",
        *_GENERIC,
        *[F.col("metadata")[key].alias(key) for key in ("tag", "score", "tags", "other", "n")],
        F.size("metadata").alias("n_metadata"),
    )


@query(
    "complete_samples",
    with_views(
        f"""SELECT rec_idx FROM parsed
            WHERE {sql_truthy("json_extract(j, '$.question')")}
              AND {sql_truthy("json_extract(j, '$.answer')")}""",
        records_sql("gsm8k"),
        _PARSED,
    ),
)
def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose question and answer hold something; null, empty and zero do not count."""
    return complete_samples(records(spark, sf_dir, "gsm8k")).select("rec_idx")


@query(
    "has_fields",
    with_views(
        """SELECT rec_idx, json_type(j, '$.question') IS NOT NULL
                  AND json_type(j, '$.answer') IS NOT NULL AS has_fields FROM parsed""",
        records_sql("gsm8k"),
        _PARSED,
    ),
)
def fields_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "gsm8k")
    present = has_fields(F.try_parse_json("value"), ("question", "answer"))
    return rows.select("rec_idx", present.alias("has_fields"))


# --- file checks: each customer's orders stand for one file of a nation's data set -------

_CHECKED_SQL = (
    records_sql("checked").replace("FROM orders", ", o_custkey AS file FROM orders"),
    _PARSED,
    """lines AS (
      SELECT *, CAST(file % 7 AS VARCHAR) AS dataset,
             row_number() OVER (PARTITION BY file ORDER BY rec_idx) - 1 AS line_idx FROM parsed)""",
    f"""rated AS (
      SELECT *, CASE
        WHEN j IS NULL THEN 'JSON decode error in line ' || (rec_idx + 1)
        WHEN json_type(j, '$.problem') IS NULL
          THEN 'Missing required field ''problem'' in sample ' || rec_idx
        WHEN json_type(j, '$.answer') IS NULL
          THEN 'Missing required field ''answer'' in sample ' || rec_idx
        WHEN NOT ({sql_truthy("json_extract(j, '$.problem')")}
                  AND {sql_truthy("json_extract(j, '$.answer')")})
          THEN 'Empty required field in sample ' || rec_idx END AS message
      FROM lines)""",
    """checks AS (
      SELECT dataset, file, count(message) = 0 AS ok,
             coalesce(first(message ORDER BY (j IS NOT NULL), rec_idx) FILTER (message IS NOT NULL),
                      'Valid JSONL with ' || count(*) || ' samples checked') AS message
      FROM rated GROUP BY dataset, file)""",
)


def _checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a customer as the file; the order key is the line number."""
    rows = records(spark, sf_dir, "checked")
    customers = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rec_idx"), F.col("o_custkey").alias("file")
    )
    return rows.drop("dataset").join(customers, "rec_idx").select(
        (F.col("file") % 7).cast("string").alias("dataset"),
        "file",
        F.col("rec_idx").alias("line_idx"),
        "rec_idx",
        "value",
    )


@query("raw_check", with_views("SELECT * FROM checks", *_CHECKED_SQL))
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_check(_checked_lines(spark, sf_dir), ("dataset", "file"), max_lines=None)


@query(
    "file_verdict",
    with_views("SELECT dataset, bool_or(ok) AS file_ok FROM checks GROUP BY dataset", *_CHECKED_SQL),
)
def light_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_verdict(raw_check(_checked_lines(spark, sf_dir), ("dataset", "file"), None))


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [normalize(records(spark, sf_dir, name), name) for name in ("math", "gsm8k", "amc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("dataset", "error")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded datasets, a known one without rows and the unknown ones named after languages."""
    known = F.explode(F.array(*map(F.lit, ("math", "gsm8k", "amc", "gpqa"))))
    languages = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset")).distinct()
    return languages.unionByName(languages.select(known.alias("dataset")).distinct())


_LOADER_SQL = """loader AS (
  SELECT name AS dataset, message LIKE 'Successfully%' AS ok, message FROM (
    SELECT 'math' AS name, 'Loader error: answer is not text' AS message
    UNION ALL SELECT dataset, 'Successfully loaded ' || (SELECT count(*) FROM orders)
      || ' samples using ' || dataset || ' loader' FROM (VALUES ('gsm8k'), ('amc')) d(dataset)
    UNION ALL SELECT 'gpqa', 'No samples loaded'
    UNION ALL SELECT DISTINCT lang, 'Unknown dataset: ' || lang FROM documents))"""


@query("loader_check", with_views("SELECT * FROM loader", _LOADER_SQL))
def loaded_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader_check(_loaded(spark, sf_dir), _named(spark, sf_dir))


_NAMED_FILES_SQL = (
    *_CHECKED_SQL,
    _LOADER_SQL,
    """names AS (SELECT unnest(['math', 'gsm8k', 'amc', 'gpqa', 'en', 'fr', 'de']) AS dataset,
                        CAST(unnest(range(7)) AS VARCHAR) AS number)""",
    """file_ok AS (SELECT names.dataset, bool_or(ok) AS file_ok
                   FROM checks JOIN names ON checks.dataset = number GROUP BY ALL)""",
    """verdicts AS (
      SELECT loader.dataset, coalesce(file_ok, false) AS file_ok, loader.ok AS loader_ok,
             coalesce(file_ok, false) AND loader.ok AS valid
      FROM loader LEFT JOIN file_ok USING (dataset))""",
)


def _dataset_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("math", "gsm8k", "amc", "gpqa", "en", "fr", "de")))
    lines = _checked_lines(spark, sf_dir).withColumn(
        "dataset", F.get(names, F.col("dataset").cast("int"))
    )
    checks = raw_check(lines, ("dataset", "file"), None)
    return dataset_verdict(checks, loader_check(_loaded(spark, sf_dir), _named(spark, sf_dir)))


@query("dataset_verdict", with_views("SELECT * FROM verdicts", *_NAMED_FILES_SQL))
def dataset_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset_verdicts(spark, sf_dir)


@query(
    "validation_totals",
    with_views(
        "SELECT count(*) FILTER (valid) AS valid_datasets, count(*) AS datasets FROM verdicts",
        *_NAMED_FILES_SQL,
    ),
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_totals(_dataset_verdicts(spark, sf_dir))


@query(
    "requested_vs_available",
    """WITH asked AS (SELECT unnest(['en', 'fr', 'xx', 'yy']) AS dataset)
       SELECT dataset, CASE WHEN dataset IN (SELECT lang FROM documents) THEN 'selected'
                            ELSE 'missing' END AS status FROM asked""",
)
def requested_vs_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("en",), ("fr",), ("xx",), ("yy",)], "dataset string")
    available = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"))
    selected, missing = requested_datasets(asked, available)
    return selected.withColumn("status", F.lit("selected")).unionByName(
        missing.withColumn("status", F.lit("missing"))
    )


@query(
    "sample_n",
    """SELECT item_id, text FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 25""",
)
def sampled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_n(table(spark, sf_dir, "benchmark"), ["item_id"], 25, seed=7)


@query(
    "sample_n_large",
    """SELECT event_id, event_type FROM events
       ORDER BY md5('3:' || event_id), event_id LIMIT 4000""",
)
def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of some thousand rows, smaller than the table from 4,000 events on."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sample_n(rows, ["event_id"], 4_000, seed=3)

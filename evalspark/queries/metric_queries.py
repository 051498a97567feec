"""Metrics, groups, percentiles and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.scoring import pass_at_k
from evalspark.operators import metrics as M
from evalspark.operators.compare import (
    comparison_documents,
    comparison_grid,
    report_lines,
    summary_lines,
    wide_comparison,
)
from evalspark.operators.judging import parse_verdicts
from evalspark.operators.percentiles import percentiles
from evalspark.queries.registry import query, table
from evalspark.queries.views import (
    ATTEMPTS_SQL,
    JUDGMENTS_SQL,
    VERDICTS_SQL,
    attempts,
    judgments,
    sql_strip,
    verdicts,
    with_views,
)

MODELS = ("m0", "m1", "m2")


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles cut to the digits on which both engines agree."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _pass_sql(n: str, c: str, k: int) -> str:
    """1 - C(n-c, k) / C(n, k) as a product of ratios."""
    product = " * ".join(f"(CAST({n} - {c} - {i} AS DOUBLE) / ({n} - {i}))" for i in range(k))
    return f"CASE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - {product} END"


def _mean_pass_sql(k: int) -> str:
    return (
        f"round(coalesce(avg(CASE WHEN n >= {k} THEN {_pass_sql('n', 'c', k)} END), 0.0), 9)"
        f" AS pass_at_{k}"
    )


_PROBLEMS_SQL = """problems AS (
  SELECT dataset, sample_id, count(*) AS n, count(*) FILTER (is_correct) AS c
  FROM attempts GROUP BY ALL)"""


@query(
    "accuracy_by_dataset",
    with_views(
        """SELECT dataset, count(*) AS total_samples,
                  count(*) FILTER (is_correct) AS correct_samples,
                  round(avg(CAST(is_correct AS INT)), 9) AS accuracy
           FROM verdicts GROUP BY dataset""",
        VERDICTS_SQL,
    ),
)
def accuracy_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.accuracy(verdicts(spark, sf_dir), ["dataset"]), "accuracy")


@query(
    "accuracy_overall",
    with_views(
        """SELECT count(*) AS total_samples, count(*) FILTER (is_correct) AS correct_samples,
                  round(coalesce(avg(CAST(is_correct AS INT)), 0.0), 9) AS accuracy
           FROM attempts""",
        ATTEMPTS_SQL,
    ),
)
def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.accuracy(attempts(spark, sf_dir)), "accuracy")


@query(
    "report_rows",
    with_views(
        """SELECT dataset, dataset || ' completed: ' || format('{:.1f}%', 100 * accuracy)
                  || ' accuracy (' || n || ' samples)' AS line
           FROM (SELECT dataset, avg(CAST(is_correct AS INT)) AS accuracy, count(*) AS n
                 FROM verdicts GROUP BY dataset)""",
        VERDICTS_SQL,
    ),
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_lines(M.accuracy(verdicts(spark, sf_dir), ["dataset"]))


@query(
    "pass_at_k",
    with_views(
        f"SELECT dataset, {', '.join(map(_mean_pass_sql, (1, 3, 5)))} FROM problems GROUP BY dataset",
        ATTEMPTS_SQL,
        _PROBLEMS_SQL,
    ),
)
def pass_at_k_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = M.pass_at_k_table(attempts(spark, sf_dir), ["dataset"])
    return rounded(table_, "pass_at_1", "pass_at_3", "pass_at_5")


@query(
    "pass_at_k_per_problem",
    with_views(
        f"""SELECT dataset, sample_id, n, c, k, round(CASE k
               WHEN 1 THEN {_pass_sql('n', 'c', 1)} WHEN 2 THEN {_pass_sql('n', 'c', 2)}
               ELSE {_pass_sql('n', 'c', 100)} END, 9) AS pass_at_k
            FROM problems, (VALUES (1), (2), (100)) ks(k)""",
        ATTEMPTS_SQL,
        _PROBLEMS_SQL,
    ),
)
def pass_at_k_per_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar rule: 1.0 also where a problem has fewer than k attempts."""
    problems = M.per_problem(attempts(spark, sf_dir), ["dataset"])
    return problems.select(
        "dataset", "sample_id", "n", "c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(100))).alias("k")
    ).withColumn("pass_at_k", F.round(pass_at_k(F.col("n"), F.col("c"), F.col("k")), 9))


@query(
    "token_efficiency",
    with_views(
        """SELECT dataset, sum(tokens_used)::BIGINT AS total_tokens,
                  round(avg(tokens_used), 9) AS avg_tokens_per_sample,
                  round(coalesce(avg(tokens_used) FILTER (is_correct), 0.0), 9)
                    AS avg_tokens_per_correct,
                  round(CASE WHEN sum(tokens_used) > 0
                        THEN count(*) FILTER (is_correct)::DOUBLE / sum(tokens_used)
                        ELSE 0.0 END, 12) AS token_efficiency
           FROM attempts GROUP BY dataset""",
        ATTEMPTS_SQL,
    ),
)
def token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.token_metrics(attempts(spark, sf_dir), ["dataset"])
    got = rounded(got, "avg_tokens_per_sample", "avg_tokens_per_correct")
    return rounded(got, "token_efficiency", digits=12)


@query(
    "confidence_summary",
    with_views(
        """SELECT dataset, round(avg(confidence), 9) AS avg_confidence,
                  round(min(confidence), 9) AS min_confidence,
                  round(max(confidence), 9) AS max_confidence,
                  round(stddev_pop(confidence), 9) AS std_confidence
           FROM attempts GROUP BY dataset""",
        ATTEMPTS_SQL,
    ),
)
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.confidence_metrics(attempts(spark, sf_dir), ["dataset"])
    return rounded(got, *[c for c in got.columns if c.endswith("_confidence")])


@query(
    "percentiles",
    "SELECT l_returnflag, "
    + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95)
    )
    + " FROM lineitem GROUP BY l_returnflag",
)
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(got, "p25", "p50", "p75", "p90", "p95", digits=6)


@query(
    "percentiles_spread",
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (10, 50, 99)
    )
    + " FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def spread_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way large groups take, whatever the size of the table."""
    rows = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    got = percentiles(rows, "l_extendedprice", keys, (10, 50, 99))
    return rounded(got, "p10", "p50", "p99", digits=6)


@query(
    "percentile_bounds",
    """SELECT round(min(value), 6) AS p0, round(quantile_cont(value, 0.5), 6) AS p50,
              round(max(value), 6) AS p100 FROM events""",
)
def percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungrouped, with the two ends."""
    got = percentiles(table(spark, sf_dir, "events"), "value", percents=(0, 50, 100))
    return rounded(got, "p0", "p50", "p100", digits=6)


@query(
    "group_metrics",
    with_views(
        """SELECT group_name, count(*) AS count, count(*) FILTER (is_correct) AS correct_count,
                  round(avg(CAST(is_correct AS INT)), 9) AS accuracy
           FROM verdicts JOIN groups ON id = sample_id GROUP BY group_name""",
        VERDICTS_SQL,
        """groups AS (
             SELECT source AS group_name, doc_id AS sample_id FROM documents
             UNION SELECT 'lang ' || lang, doc_id FROM documents)""",
    ),
)
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by source and by language, so every problem is in two."""
    documents = table(spark, sf_dir, "documents")
    names = F.explode(F.array(F.col("source"), F.concat(F.lit("lang "), F.col("lang"))))
    groups = documents.select(names.alias("group_name"), F.col("doc_id").alias("sample_id"))
    rows = verdicts(spark, sf_dir).withColumnRenamed("id", "sample_id")
    return rounded(M.group_metrics(rows, groups), "accuracy")


@query(
    "attribute_metrics",
    with_views(
        """SELECT dataset, source, grouping(source) = 1 AS is_overall, count(*) AS count,
                  count(*) FILTER (is_correct) AS correct_count,
                  round(avg(CAST(is_correct AS INT)), 9) AS accuracy
           FROM verdicts GROUP BY GROUPING SETS ((dataset), (dataset, source))""",
        VERDICTS_SQL,
    ),
)
def attribute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.attribute_metrics(verdicts(spark, sf_dir), ["dataset"], "source")
    return rounded(got, "accuracy")


def _comprehensive_sql(keys: str) -> str:
    return f"""SELECT {keys}, sum(n)::BIGINT AS total_samples, sum(c)::BIGINT AS correct_samples,
       round(sum(c) / sum(n), 9) AS accuracy, {', '.join(map(_mean_pass_sql, (1, 3, 5)))},
       sum(tokens)::BIGINT AS total_tokens,
       round(sum(tokens) / sum(n), 9) AS avg_tokens_per_sample,
       round(sum(ctokens) / sum(c), 9) AS avg_tokens_per_correct,
       round(sum(c) / sum(tokens), 12) AS token_efficiency,
       round(sum(conf) / sum(n), 9) AS avg_confidence, round(min(lo), 9) AS min_confidence,
       round(max(hi), 9) AS max_confidence, count(*) AS problem_count
     FROM (SELECT {keys}, sample_id, count(*)::DOUBLE AS n,
                  (count(*) FILTER (is_correct))::DOUBLE AS c, sum(tokens_used)::DOUBLE AS tokens,
                  coalesce(sum(tokens_used) FILTER (is_correct), 0)::DOUBLE AS ctokens,
                  sum(confidence) AS conf, min(confidence) AS lo, max(confidence) AS hi
           FROM attempts GROUP BY ALL) GROUP BY {keys}"""


def _rounded_metrics(df: DataFrame) -> DataFrame:
    exact = ("dataset", "model", "total_samples", "correct_samples", "total_tokens", "problem_count")
    got = rounded(df, *[c for c in df.columns if c not in (*exact, "token_efficiency")])
    return rounded(got, "token_efficiency", digits=12)


@query("comprehensive", with_views(_comprehensive_sql("dataset"), ATTEMPTS_SQL))
def comprehensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(M.comprehensive(attempts(spark, sf_dir), ["dataset"]))


@query("metrics_by_model", with_views(_comprehensive_sql("model, dataset"), ATTEMPTS_SQL))
def metrics_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(M.comprehensive(attempts(spark, sf_dir), ["model", "dataset"]))


def _document_field(path: str, type_: str) -> Column:
    return F.get_json_object("document", path).cast(type_)


@query(
    "metrics_documents",
    with_views(
        f"""SELECT dataset, total_samples, pass_at_3, total_tokens, max_confidence, problem_count,
                   dataset AS name, third_count, third_accuracy
            FROM ({_comprehensive_sql('dataset')}) LEFT JOIN (
              SELECT dataset, count(*) AS third_count,
                     round(avg(CAST(is_correct AS INT)), 9) AS third_accuracy
              FROM attempts WHERE sample_id % 3 = 0 GROUP BY dataset) USING (dataset)""",
        ATTEMPTS_SQL,
    ),
)
def metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON form with a group of problems, read back by path."""
    rows = attempts(spark, sf_dir)
    groups = rows.filter(F.col("sample_id") % 3 == 0).select(
        F.lit("third").alias("group_name"), "sample_id"
    )
    grouped = M.group_metrics(rows, groups, ["dataset"])
    documents = M.metrics_documents(M.comprehensive(rows, ["dataset"]), grouped=grouped)
    got = documents.select(
        "dataset",
        _document_field("$.overall.total_samples", "bigint").alias("total_samples"),
        _document_field("$.overall.pass_at_k.3", "double").alias("pass_at_3"),
        _document_field("$.token_efficiency.total_tokens", "bigint").alias("total_tokens"),
        _document_field("$.confidence_metrics.max_confidence", "double").alias("max_confidence"),
        _document_field("$.problem_count", "bigint").alias("problem_count"),
        _document_field("$.dataset_info.name", "string").alias("name"),
        _document_field("$.group_metrics.third.count", "bigint").alias("third_count"),
        _document_field("$.group_metrics.third.accuracy", "double").alias("third_accuracy"),
    )
    return rounded(got, "pass_at_3", "max_confidence", "third_accuracy")


@query(
    "problem_count",
    with_views(
        """SELECT dataset, model, count(DISTINCT sample_id) AS problem_count
           FROM attempts GROUP BY dataset, model""",
        ATTEMPTS_SQL,
    ),
)
def problem_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.problem_count(attempts(spark, sf_dir), ["dataset", "model"])


@query(
    "progress",
    with_views(
        "SELECT dataset, count(*) AS rows_done FROM attempts GROUP BY dataset", ATTEMPTS_SQL
    ),
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.progress(attempts(spark, sf_dir))


_LABEL_SQL = f"lower({sql_strip('judgment')})"
_BARE_SQL = sql_strip("translate(judgment, '[]', '')")


@query(
    "verdict_prefix",
    with_views(
        f"""SELECT o_orderkey, judgment, starts_with(lower({_BARE_SQL}), 'correct') AS is_correct,
                   {_LABEL_SQL} IN ('correct', 'incorrect') AS judge_valid FROM judgments""",
        JUDGMENTS_SQL,
    ),
)
def verdict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_verdicts(judgments(spark, sf_dir), mode="prefix").drop("judge")


@query(
    "verdict_exact",
    with_views(
        f"""SELECT o_orderkey, judgment, {_LABEL_SQL} = 'correct' AS is_correct,
                   {_LABEL_SQL} IN ('correct', 'incorrect') AS judge_valid FROM judgments""",
        JUDGMENTS_SQL,
    ),
)
def verdict_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_verdicts(judgments(spark, sf_dir), mode="exact").drop("judge")


@query(
    "stat_results",
    with_views(
        f"""SELECT judge, count(*) FILTER ({_LABEL_SQL} IN ('correct', 'incorrect')) AS valid_num,
                   count(*) FILTER ({_LABEL_SQL} = 'correct') AS correct_num,
                   count(*) FILTER ({_LABEL_SQL} = 'incorrect') AS incorrect_num,
                   round(avg(CAST({_LABEL_SQL} = 'correct' AS INT)), 9) AS accuracy
            FROM judgments GROUP BY judge""",
        JUDGMENTS_SQL,
    ),
)
def stat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.judge_statistics(judgments(spark, sf_dir), by=["judge"]), "accuracy")


# The comparison leaves out one model's runs on one dataset, so the grid has a gap.
_COMPARED_SQL = f"""metrics AS (
  SELECT * FROM ({_comprehensive_sql('model, dataset')})
  WHERE NOT (model = 'm1' AND dataset = '2')),
grid AS (
  SELECT dataset, model, accuracy, total_samples, pass_at_1, pass_at_3
  FROM (SELECT DISTINCT dataset FROM metrics)
  CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) names(model)
  LEFT JOIN metrics USING (dataset, model))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.comprehensive(attempts(spark, sf_dir), ["model", "dataset"])
    kept = rows.filter(~((F.col("model") == "m1") & (F.col("dataset") == "2")))
    return comparison_grid(kept, MODELS)


@query("compare_models", with_views("SELECT * FROM grid", ATTEMPTS_SQL, _COMPARED_SQL))
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grid(spark, sf_dir), "accuracy", "pass_at_1", "pass_at_3")


@query(
    "compare_models_wide",
    with_views(
        """SELECT dataset, max(accuracy) FILTER (model = 'm0') AS m0,
                  max(accuracy) FILTER (model = 'm1') AS m1,
                  max(accuracy) FILTER (model = 'm2') AS m2 FROM grid GROUP BY dataset""",
        ATTEMPTS_SQL,
        _COMPARED_SQL,
    ),
)
def compare_models_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wide_comparison(_grid(spark, sf_dir), MODELS), *MODELS)


@query(
    "comparison_documents",
    with_views(
        """SELECT dataset, model, total_samples IS NULL AS is_null, total_samples, pass_at_1
           FROM grid""",
        ATTEMPTS_SQL,
        _COMPARED_SQL,
    ),
)
def comparison_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = comparison_documents(_grid(spark, sf_dir)).select(
        "dataset",
        "model",
        (F.col("document") == "null").alias("is_null"),
        _document_field("$.total_samples", "bigint").alias("total_samples"),
        _document_field("$.pass_at_1", "double").alias("pass_at_1"),
    )
    return rounded(got, "pass_at_1")


@query(
    "comparison_report",
    with_views(
        """SELECT dataset, 4 AS line_no, model, '| ' || model || CASE
             WHEN total_samples IS NULL THEN ' | - | - | - | - |'
             ELSE format(' | {:.3f} | {:.3f} | {:.3f} | {} |', accuracy, pass_at_1, pass_at_3,
                         total_samples) END AS line FROM grid
           UNION ALL
           SELECT dataset, line_no, '' AS model,
                  CASE line_no WHEN 0 THEN '## ' || upper(dataset) ELSE text END AS line
           FROM (SELECT DISTINCT dataset FROM grid), (VALUES (0, ''), (1, ''),
             (2, '| Model | Accuracy | Pass@1 | Pass@3 | Samples |'),
             (3, '|-------|----------|--------|--------|---------|'), (5, '')) head(line_no, text)
        """,
        ATTEMPTS_SQL,
        _COMPARED_SQL,
    ),
)
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_lines(_grid(spark, sf_dir))

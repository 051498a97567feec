"""The given tables seen as evaluation data.

Each view is stated once as a DataFrame and once as SQL for the oracle. Texts and JSON
records are rendered by expressions that mean the same in both dialects, which is why line
feeds and backslashes are written as ``chr(10)`` and ``chr(92)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import WHITESPACE
from evalspark.queries.registry import spread, table

# --- verdicts: labelled documents -------------------------------------------------------

VERDICTS_SQL = """verdicts AS (
  SELECT d.doc_id AS id, d.lang AS dataset, d.source, l.quality = 1 AS is_correct,
         CAST(d.n_chars // 4 AS BIGINT) AS tokens_used
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("dataset"),
        "source",
        (F.col("quality") == 1).alias("is_correct"),
        F.floor(F.col("n_chars") / 4).alias("tokens_used"),
    )


# --- attempts: many generations per problem ---------------------------------------------

ATTEMPTS_SQL = """attempts AS (
  SELECT user_id AS sample_id, CAST(user_id % 4 AS VARCHAR) AS dataset,
         'm' || CAST(event_id % 3 AS VARCHAR) AS model, event_type = 'purchase' AS is_correct,
         CAST(floor(value) AS BIGINT) AS tokens_used, value / (1 + value) AS confidence
  FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"),
        (F.col("user_id") % 4).cast("string").alias("dataset"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        (F.col("event_type") == "purchase").alias("is_correct"),
        F.floor(value).alias("tokens_used"),
        (value / (1 + value)).alias("confidence"),
    )


# --- turns: prompts and outputs of conversations ----------------------------------------

TURNS_SQL = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS problem, a.text AS output
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    user = rows.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("problem")
    )
    reply = rows.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return user.join(reply, ["conv_id", "turn"])


# --- texts: numbers of line items in answer phrases -------------------------------------

_LF, _CR, _BS = "chr(10)", "chr(13)", "chr(92)"
_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
_PART = "CAST(l_partkey AS STRING)"

_TEMPLATES = (
    f"'Add the parts.' || {_LF} || 'The answer is: ' || {_PRICE} || {_LF} || 'end'",
    f"'So ' || {_BS} || 'boxed{{' || {_PART} || '}} or ' || {_BS} || 'boxed{{2}}'",
    f"'Done.' || {_LF} || 'Final answer: ' || {_PART} || ' units  ' || {_LF} || 'more'",
    f"'My answer:' || {_LF} || {_LF} || ' ' || {_PART}",
    f"'Small x.' || {_LF} || 'Therefore, ' || {_PRICE} || ' holds' || {_CR} || {_LF} || 'ok'",
    f"'Solution: take ' || {_PART} || {_LF} || 'therefore ' || {_PRICE}",
    f"'  plain ' || {_PRICE} || ' text -' || {_PART} || '  '",
    f"'Steps #### ' || {_PART} || ' #### 1,234,' || {_PART} || ' '",
    f"'Nested ' || {_BS} || 'boxed{{' || {_BS} || 'frac{{' || {_PART} || '}}{{2}}}} tail'",
    f"'<think>the answer is 1</think>  the answer is ' || {_PART} || ' </think> x'",
    f"' 　' || {_PRICE} || ' é 😀 '",
    f"{_BS} || 'boxed{{}} empty ' || {_PART}",
    f"'first ' || {_PART} || {_LF} || ' last line ' || {_PRICE} || ' ' || {_LF} || {_LF}",
)


_TEXT = (
    f"CASE (l_orderkey + l_linenumber) % {len(_TEMPLATES)} "
    + " ".join(f"WHEN {i} THEN {template}" for i, template in enumerate(_TEMPLATES))
    + " END"
)


TEXTS_SQL = f"""texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TEXT} AS text
  FROM lineitem)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return spread(table(spark, sf_dir, "lineitem").select(*columns)).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.expr(_TEXT).alias("text"),
    )


# --- judgments: verdict texts of orders -------------------------------------------------

_JUDGMENTS = (
    "'Correct'", "'[Correct]'", "'[Incorrect]'", "'correct. ok'", "'Incorrect'", "''",
    "' CORRECT ' || chr(10)", "'unsure'", "' incorrect　'", "'in[correct]'",
)
_JUDGMENT = "CASE o_orderkey % 10 " + " ".join(
    f"WHEN {i} THEN {text}" for i, text in enumerate(_JUDGMENTS)
) + " END"

JUDGMENTS_SQL = f"""judgments AS (
  SELECT o_orderkey, o_orderpriority AS judge, {_JUDGMENT} AS judgment FROM orders)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("judge"), F.expr(_JUDGMENT).alias("judgment")
    )


# --- records: JSON lines of orders ------------------------------------------------------

# d is a cent amount as decimal text, k the key, t a text with phrases
_K, _D = "CAST(o_orderkey AS STRING)", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_Q = "'\"'"


def _field(name: str, value: str) -> str:
    return f"'\"{name}\":' || {value}"


def _quoted(value: str) -> str:
    return f"{_Q} || {value} || {_Q}"


def _object(*fields: str) -> str:
    inner = " || ',' || ".join(fields)
    return f"'{{' || {inner} || '}}'"


_ESC = "chr(92)"
_STATEMENT = f"'What is ' || {_K} || ' plus é' || {_ESC} || 'n1?'"
_BOXED = f"'Sum. ' || {_ESC} || {_ESC} || 'boxed{{' || {_D} || '}} ok'"
_PHRASE = f"'Steps' || {_ESC} || 'nthe answer is: ' || {_D} || ' ' || {_ESC} || 'nend'"
_SOLVED = f"'Solution ' || {_K} || {_ESC} || 'n'"
_MARKED = f"'Add up. #### 1,' || {_K}"
_NUMBERED = f"'first 3 then -' || {_D} || ' left'"


def _options(names: str) -> str:
    return f"'\"{names}\":[\"red ' || {_K} || '\",\"blue\",27.0,true,null]'"


RECORD_TEMPLATES = {
    "math": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("solution", _quoted(_BOXED)), "'\"level\":\"Level 5\",\"type\":\"Algebra\"'"),
        _object(_field("problem", _quoted(_STATEMENT)), _field("solution", _quoted(_PHRASE)), "'\"level\":null'"),
        _object(_field("solution", _quoted(_SOLVED)), "'\"type\":\"Geometry\"'"),
        _object(_field("problem", _quoted(_STATEMENT))),
        _object(_field("problem", _quoted(_STATEMENT)), _field("solution", _K)),
        f"'{{\"problem\": broken ' || {_K}",
    ),
    "gsm8k": (
        _object(_field("question", _quoted(_STATEMENT)), _field("answer", _quoted(_MARKED))),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted(_NUMBERED))),
        _object(_field("question", "'null'"), _field("problem", _quoted(_STATEMENT)), _field("answer", _K)),
        _object(_field("question", _quoted(_STATEMENT)), "'\"answer\":null'"),
        _object(_field("question", _quoted("'none ' || 'here '")), _field("answer", _quoted("'no number '"))),
    ),
    "aime": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _K), "'\"year\":2024,\"contest\":\"I\"'"),
        _object(_field("question", _quoted(_STATEMENT)), _field("answer", _quoted(_D))),
        _object(_field("problem", "'\"\"'"), _field("question", _quoted(_STATEMENT)), "'\"answer\":true'"),
        _object(_field("problem", _quoted(_STATEMENT)), "'\"answer\":null,\"year\":null'"),
    ),
    "olympiadbench": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted(_BOXED)), "'\"subject\":\"Maths\",\"year\":2020'"),
        _object(_field("question", _quoted(_STATEMENT)), _field("solution", _quoted(_SOLVED)), "'\"country\":\"x\"'"),
        _object(_field("problem", _quoted(_STATEMENT)), "'\"answer\":\"\"'", _field("solution", _quoted(_SOLVED))),
        _object(_field("problem", _quoted(_STATEMENT)), "'\"answer\":null'", _field("solution", _quoted(_SOLVED))),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", "'[\"' || " + _D + " || '\"]'")),
    ),
    "mmlu-pro": (
        _object(_field("question", _quoted(_STATEMENT)), _options("options"), "'\"answer\":\"A\",\"category\":\"law\",\"answer_index\":0'"),
        _object(_field("problem", _quoted(_STATEMENT)), _options("choices"), "'\"answer\":\"B\",\"subject\":\"history\"'"),
        _object(_field("question", _quoted(_STATEMENT)), "'\"options\":[],\"answer\":null'", _options("choices")),
        _object(_field("question", _quoted(_STATEMENT + " || ' '")), _field("answer", _K)),
    ),
    "amc": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _K + " || '.0'"), "'\"year\":2023'"),
        _object(_field("question", _quoted(_STATEMENT)), _field("answer", _K), "'\"problem_number\":7'"),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", "'false'")),
        _object(_field("problem", _quoted(_STATEMENT))),
    ),
    "gpqa": (
        _object(_field("question", _quoted(_STATEMENT)), _field("correct_answer", _quoted(_D)), "'\"domain\":\"Physics\"'"),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted(_K))),
        _object(_field("question", _quoted(_STATEMENT)), "'\"correct_answer\":null'", _field("answer", _quoted(_K))),
        _object(_field("question", _quoted(_STATEMENT)), "'\"explanation\":\"why\"'"),
    ),
    "minerva": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted(_PHRASE)), "'\"level\":3'"),
        _object(_field("question", _quoted(_STATEMENT)), _field("solution", _quoted(_BOXED))),
        _object(_field("problem", _quoted(_STATEMENT)), "'\"answer\":0'"),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _K + " || '7'")),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted("' ' || " + _K + " || ' '"))),
    ),
    "generic": (
        _object(_field("input", _quoted(_STATEMENT)), _field("target", _quoted(_D)), _field("idx", _K), "'\"tag\":\"a\",\"score\":27'"),
        _object(_field("query", _quoted(_STATEMENT)), _field("output", _K), "'\"problem_id\":\"p1\"'"),
        _object(_field("question", "'null'"), _field("problem", _quoted(_STATEMENT)), _field("answer", "'true'"), "'\"tags\":[1,2]'"),
        _object("'\"other\":\"x\"'", _field("n", _K)),
    ),
    # raw files for the format check: fine, field missing, field empty, unreadable
    "checked": (
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", "'1' || " + _K)),
        _object(_field("problem", _quoted(_STATEMENT)), _field("answer", _quoted(_D))),
        _object(_field("question", _quoted(_STATEMENT)), _field("answer", _quoted(_D))),
        _object(_field("problem", _quoted(_STATEMENT)), _field("solution", _quoted(_D))),
        _object(_field("problem", _quoted(_STATEMENT)), "'\"answer\":0'"),
        _object("'\"problem\":null'", _field("answer", _quoted(_D))),
        f"'{{\"problem\": broken ' || {_K}",
    ),
}
RECORD_TEMPLATES["aime25"] = RECORD_TEMPLATES["aime"]


def record_expression(kind: str) -> str:
    """JSON text of an order in one of the record shapes."""
    shapes = RECORD_TEMPLATES[kind]
    branches = " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(shapes))
    return f"CASE o_orderkey % {len(shapes)} {branches} END"


def records_sql(kind: str) -> str:
    return f"""records AS (
  SELECT o_orderkey AS rec_idx, {record_expression(kind)} AS value FROM orders)"""


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Raw rows as the normalisers take them, one per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return spread(orders).select(
        F.lit(kind).alias("dataset"),
        F.lit("test").alias("split"),
        F.col("o_orderkey").alias("rec_idx"),
        F.expr(record_expression(kind)).alias("value"),
    )


# --- SQL spellings used by several oracles ----------------------------------------------

STRIP_CHARACTERS = "'" + WHITESPACE + "'"


def sql_strip(text: str) -> str:
    return f"trim({text}, {STRIP_CHARACTERS})"


def with_views(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {body}"

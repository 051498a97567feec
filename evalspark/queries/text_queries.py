"""Cleaning, extraction and prompts over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import prompts as P
from evalspark.functions.extraction import RULES, extract_answer
from evalspark.functions.reporting import iso_stamp, run_stamp
from evalspark.functions.text import (
    WHITESPACE_CLASS,
    clean_output,
    lettered_options,
    short_name,
    truncate_tokens,
)
from evalspark.operators.judging import clean_outputs, extract_answers
from evalspark.operators.keyed_joins import join_generations, with_templates
from evalspark.queries.registry import query, table
from evalspark.queries.views import (
    TEXTS_SQL,
    TURNS_SQL,
    sql_strip,
    texts,
    turns,
    with_views,
)


def sql_clean(text: str, tail: int | None = None) -> str:
    """Text after the first end tag, its last characters if a number is given, stripped."""
    after = sql_strip(f"substr({text}, strpos({text}, '</think>') + 8)")
    part = f"CASE WHEN contains({text}, '</think>') THEN {after} ELSE {text} END"
    return sql_strip(part if tail is None else f"right({part}, {tail})")


_WRAPPED_SQL = """CASE conv_id % 4
  WHEN 0 THEN 'let me think' || chr(10) || '</think>' || chr(10) || output || ' '
  WHEN 1 THEN '<think>' || problem || '</think>' || output || '</think> ' || output
  WHEN 2 THEN output || repeat(' 😀é', 400) || '  '
  ELSE output END"""


@query(
    "clean_output",
    with_views(
        f"""SELECT conv_id, turn, {sql_clean('wrapped', 1000)} AS clean_output
            FROM (SELECT *, {_WRAPPED_SQL} AS wrapped FROM turns)""",
        TURNS_SQL,
    ),
)
def clean_wrapped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = turns(spark, sf_dir).withColumn("wrapped", F.expr(_WRAPPED_SQL))
    return clean_outputs(wrapped, "wrapped", tail=1000).select("conv_id", "turn", "clean_output")


@query("clean_documents", f"SELECT doc_id, {sql_clean('text', 1000)} AS clean_output FROM documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", clean_output(F.col("text"), 1000).alias("clean_output")
    )


@query(
    "truncate",
    "SELECT doc_id, left(text, 800) AS short, text AS unlimited FROM documents",
)
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        truncate_tokens(text, 200).alias("short"),
        truncate_tokens(text, 0).alias("unlimited"),
    )


# --- extraction -------------------------------------------------------------------------

SQL_BOXED = r"\\boxed\{([^}]*)\}"
SQL_PHRASES = {
    "general": ("[Tt]he answer is:?", "[Ff]inal answer:?", "[Aa]nswer:?", "[Tt]herefore,?"),
    "output": ("[Tt]he answer is:?", "[Ff]inal answer:?", "[Aa]nswer:?"),
    "minerva": ("[Tt]he answer is:?", "[Ff]inal answer:?", "[Aa]nswer:?"),
    "olympiad": ("[Aa]nswer:?", "[Ss]olution:?", "[Tt]herefore,?"),
    "math": (),
}


def sql_extract(text: str, rule: str) -> str:
    """The rules as ordered CASE branches over RE2 patterns."""
    if rule == "gsm8k":
        last_mark = sql_strip(f"list_extract(string_split({text}, '####'), -1)")
        last_number = rf"list_extract(regexp_extract_all({text}, '-?\d+(?:\.\d+)?'), -1)"
        return (
            f"CASE WHEN contains({text}, '####') THEN replace({last_mark}, ',', '')"
            f" ELSE coalesce({last_number}, {sql_strip(text)}) END"
        )
    fallback = sql_strip(text)
    if rule == "math":
        fallback = sql_strip(f"list_extract(string_split({sql_strip(text)}, chr(10)), -1)")
    branches = [
        f"WHEN regexp_matches({text}, '{SQL_BOXED}') THEN regexp_extract({text}, '{SQL_BOXED}', 1)"
    ]
    for phrase in SQL_PHRASES[rule]:
        pattern = rf"{phrase}{WHITESPACE_CLASS}*(.+?)(?:\n|$)"
        found = sql_strip(f"regexp_extract({text}, '{pattern}', 1)")
        branches.append(f"WHEN regexp_matches({text}, '{pattern}') THEN {found}")
    return f"CASE {' '.join(branches)} ELSE {fallback} END"


def _register_extraction(rule: str) -> None:
    sql = with_views(
        f"SELECT l_orderkey, l_linenumber, text, {sql_extract('text', rule)} AS extracted FROM texts",
        TEXTS_SQL,
    )

    @query(f"extract_{rule}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = texts(spark, sf_dir).select("l_orderkey", "l_linenumber", "text")
        return extract_answers(rows, rule, "text")

    document_sql = f"SELECT doc_id, {sql_extract('text', rule)} AS extracted FROM documents"

    @query(f"extract_{rule}_documents", document_sql)
    def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", "text")
        return extract_answers(rows, rule, "text").drop("text")


for _rule in RULES:
    _register_extraction(_rule)


# --- prompts ----------------------------------------------------------------------------


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, question: str, output: str, answer: str) -> str:
    filled = sql_literal(template)
    # answer first: the texts put in later are not searched again
    for slot, column in (("answer", answer), ("output", output), ("question", question)):
        head, tail = filled.split("{" + slot + "}")
        filled = f"{head}' || {column} || '{tail}"
    return filled


_ITEM_SQL = """items AS (
  SELECT conv_id, turn, problem, output, coalesce(b.text, problem) AS item, conv_id AS answer
  FROM turns LEFT JOIN benchmark b ON b.item_id = conv_id)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the benchmark text of their number, or their own where there is none."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("conv_id"), F.col("text").alias("item")
    )
    return (
        turns(spark, sf_dir)
        .join(items, "conv_id", "left")
        .withColumn("item", F.coalesce("item", "problem"))
        .withColumn("answer", F.col("conv_id"))
    )


@query(
    "prompt_judge",
    with_views(
        "SELECT conv_id, turn, "
        + sql_fill(P.JUDGE_TEMPLATE, "item", sql_clean("output"), "CAST(answer AS VARCHAR)")
        + " AS prompt FROM items",
        TURNS_SQL,
        _ITEM_SQL,
    ),
)
def prompt_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = P.judge_prompt(F.col("item"), clean_output(F.col("output")), F.col("answer"))
    return _items(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "prompt_short",
    with_views(
        "SELECT conv_id, turn, "
        + sql_fill(P.SHORT_TEMPLATE, "item", "output", "CAST(answer AS VARCHAR)")
        + " AS prompt FROM items",
        TURNS_SQL,
        _ITEM_SQL,
    ),
)
def prompt_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = P.short_judge_prompt(F.col("item"), F.col("output"), F.col("answer"))
    return _items(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))


# every third conversation has an empty system text, every third none
_SYSTEM_SQL = "CASE conv_id % 3 WHEN 0 THEN 'You solve problems.' WHEN 1 THEN '' END"
_BOXED_SQL = sql_literal(P.BOXED_INSTRUCTION)


@query(
    "prompt_math",
    with_views(
        f"""SELECT conv_id, turn,
                   CASE WHEN conv_id % 3 = 0 THEN 'You solve problems.' || chr(10) || chr(10)
                        ELSE '' END || 'Problem: ' || problem || chr(10) || chr(10) || {_BOXED_SQL}
                   AS prompt FROM turns""",
        TURNS_SQL,
    ),
)
def prompt_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        P.math_prompt(F.col("problem"), F.expr(_SYSTEM_SQL)).alias("prompt"),
    )


@query(
    "chat_messages",
    with_views(
        f"""SELECT conv_id, turn, 0 AS pos, 'system' AS role, 'You solve problems.' AS content
            FROM turns WHERE conv_id % 3 = 0
            UNION ALL
            SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END, 'user',
                   problem || chr(10) || chr(10) || {_BOXED_SQL} FROM turns""",
        TURNS_SQL,
    ),
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = P.chat_messages(F.col("problem"), F.expr(_SYSTEM_SQL))
    return (
        turns(spark, sf_dir)
        .select("conv_id", "turn", F.posexplode(messages).alias("pos", "message"))
        .select("conv_id", "turn", "pos", "message.role", "message.content")
    )


@query(
    "render_template",
    """SELECT conv_id, turn, '<' || role || '>' || text || '<end>' || role AS rendered
       FROM conversations""",
)
def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat template per role, looked up by name."""
    rows = table(spark, sf_dir, "conversations")
    templates = rows.select(F.col("role").alias("judge_name")).distinct().withColumn(
        "template", F.concat(F.lit("<"), "judge_name", F.lit(">{query}<end>"), "judge_name")
    )
    return with_templates(rows, templates, "role").select(
        "conv_id", "turn", P.render_template(F.col("template"), F.col("text")).alias("rendered")
    )


@query(
    "join_generations",
    """WITH asked AS (
         SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
                     OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations
       ), replies AS (
         SELECT conv_id, asked AS turn, text AS output,
                row_number() OVER (PARTITION BY conv_id, asked ORDER BY turn) - 1 AS generation_id
         FROM asked WHERE role = 'assistant')
       SELECT conv_id, turn, u.text AS problem, generation_id, output
       FROM conversations u JOIN replies USING (conv_id, turn) WHERE u.role = 'user'""",
)
def generations_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of every conversation with the replies up to the next question."""
    rows = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    asked = F.last(F.when(user, F.col("turn")), ignorenulls=True).over(
        Window.partitionBy("conv_id").orderBy("turn")
    )
    number = F.row_number().over(Window.partitionBy("conv_id", "asked").orderBy("turn")) - 1
    replies = (
        rows.withColumn("asked", asked)
        .filter(F.col("role") == "assistant")
        .select("conv_id", F.col("asked").alias("turn"), number.alias("generation_id"), F.col("text").alias("output"))
    )
    samples = rows.filter(user).select("conv_id", "turn", F.col("text").alias("problem"))
    return join_generations(samples, replies, ["conv_id", "turn"])


@query(
    "extract_balanced",
    """SELECT l_orderkey, l_linenumber,
              CASE l_linenumber % 4 WHEN 3 THEN 'no box' ELSE chr(92) || 'frac{' || l_orderkey || '}{{' || l_partkey || '}}'
                || CASE l_linenumber % 4 WHEN 0 THEN chr(92) || '{' ELSE ' x' END END AS answer
       FROM lineitem""",
)
def extract_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxed answers with braces inside, one kind with an escaped brace and one that is never closed."""
    kind = F.col("l_linenumber") % 4
    inside = F.concat(
        F.lit("\\frac{"), "l_orderkey", F.lit("}{{"), "l_partkey", F.lit("}}"), F.when(kind == 0, "\\{").otherwise(" x")
    )
    boxed = F.concat(F.lit("So \\boxed{"), inside, F.lit("}. Not {this}."))
    text = F.when(kind == 3, "open \\boxed{{a}\nno box").otherwise(boxed)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", extract_answer(text, "math", balanced=True).alias("answer")
    )


@query(
    "time_stamps",
    """SELECT o_orderkey, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_stamp
       FROM (SELECT o_orderkey, make_timestamp(o_orderkey * 1000003) AS ts FROM orders)""",
)
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two spellings of a time that runs and metrics carry."""
    ts = F.timestamp_micros(F.col("o_orderkey") * 1_000_003)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", run_stamp(ts).alias("run_stamp"), iso_stamp(ts).alias("iso_stamp")
    )


@query(
    "format_options",
    """SELECT p_partkey, trim(p_name || '?' || chr(10) || chr(10) || 'Options:' || chr(10)
         || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. '
         || CAST(p_size AS VARCHAR)) AS problem FROM part""",
)
def format_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    question = F.concat("p_name", F.lit("?"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", lettered_options(question, choices).alias("problem")
    )


@query(
    "model_short_name",
    "SELECT page_id, list_extract(string_split(url, '/'), -1) AS short_name FROM pages",
)
def model_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", short_name(F.col("url")).alias("short_name")
    )

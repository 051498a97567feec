"""Prompt texts and chat messages built from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: asks for the mark-up that answer extraction looks for.
BOXED_INSTRUCTION = (
    "Let's reason step by step, and put your final answer within \\boxed{}."
)

# Default judge template. A judge trained on other wording takes its own through ``template``;
# the slots and the two bracketed labels are the contract.
JUDGE_TEMPLATE = (
    "Decide whether the output below answers the question, given the reference answer.\n"
    "Judge the last answer the output settles on; treat equivalent forms as equal; an option "
    "letter or its content both count; an unclear answer does not count.\n"
    "Reply with [Correct] or [Incorrect] only.\n\n"
    'Question: """{question}"""\n\n'
    'Output: """{output}"""\n\n'
    "Correct answer: {answer}\n\n"
    "Judgement:\n"
)

SHORT_TEMPLATE = (
    "Is this answer right?\n\n"
    "Question: {question}\n\n"
    "Model output: {output}\n\n"
    "Correct answer: {answer}\n\n"
    'Reply "Correct" or "Incorrect", then explain briefly.'
)

_SLOT = re.compile(r"\{(question|output|answer)\}")


def fill_template(template: str, question: Column, output: Column, answer: Column) -> Column:
    """Put columns into ``{question}``, ``{output}`` and ``{answer}``; a null reads ``None``."""
    slots = {"question": question, "output": output, "answer": answer}
    parts = _SLOT.split(template)
    columns = [
        F.coalesce(slots[part].cast("string"), F.lit("None")) if i % 2 else F.lit(part)
        for i, part in enumerate(parts)
        if part
    ]
    return F.concat(*columns)


def judge_prompt(
    question: Column, output: Column, answer: Column, template: str = JUDGE_TEMPLATE
) -> Column:
    return fill_template(template, question, output, answer)


def short_judge_prompt(question: Column, output: Column, answer: Column) -> Column:
    return fill_template(SHORT_TEMPLATE, question, output, answer)


def _system_or_null(system: Column | str | None) -> Column:
    column = system if isinstance(system, Column) else F.lit(system).cast("string")
    return F.nullif(column, F.lit(""))


def math_prompt(problem: Column, system: Column | str | None = None) -> Column:
    """Optional system text, the problem and the boxed instruction; an empty system is left out."""
    return F.concat_ws(
        "\n\n",
        _system_or_null(system),
        F.concat(F.lit("Problem: "), F.coalesce(problem, F.lit("None"))),
        F.lit(BOXED_INSTRUCTION),
    )


def chat_messages(problem: Column, system: Column | str | None = None) -> Column:
    """``[system?, user]`` as an array of role and content."""
    user = F.concat(F.coalesce(problem, F.lit("None")), F.lit("\n\n" + BOXED_INSTRUCTION))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), _system_or_null(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return F.filter(messages, lambda message: message["content"].isNotNull())


def render_template(template: Column, prompt: Column) -> Column:
    """A judge's chat template with ``{query}`` replaced by the prompt."""
    return F.replace(template, F.lit("{query}"), prompt)

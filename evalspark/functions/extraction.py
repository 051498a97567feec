"""Answer extraction: ordered patterns, first one that matches decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import WHITESPACE_CLASS, strip

# The marked-up answer and the phrases that introduce an answer. Each phrase
# carries a plain substring that any match must contain, as a cheap test before the regex.
BOXED = r"\\boxed\{([^}]*)\}"
PHRASES = {
    "the answer is": ("he answer is", r"[Tt]he answer is:?"),
    "final answer": ("inal answer", r"[Ff]inal answer:?"),
    "answer": ("nswer", r"[Aa]nswer:?"),
    "solution": ("olution", r"[Ss]olution:?"),
    "therefore": ("herefore", r"[Tt]herefore,?"),
}
GSM8K_MARK = "####"
NUMBER = r"-?\p{Nd}+(?:\.\p{Nd}+)?"

RULE_PHRASES = {
    "general": ("the answer is", "final answer", "answer", "therefore"),
    "output": ("the answer is", "final answer", "answer"),
    "minerva": ("the answer is", "final answer", "answer"),
    "olympiad": ("answer", "solution", "therefore"),
    "math": (),
}
RULES = (*RULE_PHRASES, "gsm8k")


def phrase_pattern(phrase: str) -> str:
    """Rest of the line after the phrase; ``(?d)`` lets ``.`` stop at a line feed only."""
    return rf"(?d){PHRASES[phrase][1]}{WHITESPACE_CLASS}*(.+?)(?:\n|$)"


def has_boxed(text: Column) -> Column:
    return F.contains(text, F.lit("\\boxed{")) & text.rlike(BOXED)


def balanced_boxed(text: Column) -> Column:
    """What the first boxed answer holds, up to the brace that closes it; null if there is none or it isn't closed.

    Braces behind a backslash are text. The characters are folded as runs between braces, so the work is linear.
    """
    mark = F.lit("\\boxed{")
    rest = F.substr(text, F.instr(text, mark) + F.length(mark))
    runs = F.regexp_extract_all(rest, F.lit(r"(?s)\\.|[{}]|[^{}\\]++|\\$"), F.lit(0))

    def step(state: Column, run: Column) -> Column:
        depth = state["depth"] + F.when(run == "{", 1).when(run == "}", -1).otherwise(0)
        closed = (state["end"] < 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            (state["at"] + F.length(run)).alias("at"),
            F.when(closed, state["at"]).otherwise(state["end"]).alias("end"),
        )

    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    end = F.aggregate(runs, begin, step, lambda state: state["end"])
    held = F.filter(F.array(end), lambda e: e >= 0)
    inside = F.get(F.transform(held, lambda e: F.substr(rest, F.lit(1), e)), F.lit(0))
    return F.when(F.contains(text, mark), inside)


def _phrase_branch(text: Column, phrase: str) -> tuple[Column, Column]:
    pattern = phrase_pattern(phrase)
    found = F.contains(text, F.lit(PHRASES[phrase][0])) & text.rlike(pattern)
    return found, strip(F.regexp_extract(text, pattern, 1))


def _last_line(text: Column) -> Column:
    return strip(F.substring_index(strip(text), "\n", -1))


def gsm8k_answer(text: Column) -> Column:
    """Text after the last ``####`` without commas, else the last number, else the text."""
    marked = F.element_at(F.split(text, GSM8K_MARK), -1)
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.when(
        F.contains(text, F.lit(GSM8K_MARK)), F.replace(strip(marked), F.lit(","), F.lit(""))
    ).otherwise(F.coalesce(F.try_element_at(numbers, F.lit(-1)), strip(text)))


def extract_answer(text: Column, rule: str = "general", balanced: bool = False) -> Column:
    """The answer stated in ``text`` under one of ``RULES``.

    A boxed answer ends at the first closing brace, or with ``balanced`` at the one that matches its opening brace.
    """
    if rule not in RULES:
        raise ValueError(f"unknown extraction rule {rule!r}, expected one of {RULES}")
    if rule == "gsm8k":
        return gsm8k_answer(text)
    if rule in ("minerva", "olympiad"):
        text = F.coalesce(text, F.lit(""))
    fallback = _last_line(text) if rule == "math" else strip(text)
    if balanced:
        inside = balanced_boxed(text)
        branches = [(inside.isNotNull(), inside)]
    else:
        branches = [(has_boxed(text), F.regexp_extract(text, BOXED, 1))]
    branches += [_phrase_branch(text, phrase) for phrase in RULE_PHRASES[rule]]
    first, *rest = branches
    chain = reduce(lambda c, branch: c.when(*branch), rest, F.when(*first))
    return chain.otherwise(fallback)

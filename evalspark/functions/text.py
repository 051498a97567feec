"""Text helpers with Python string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = f"[{WHITESPACE}]"

THINK_END = "</think>"
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (plain ``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def clean_output(output: Column, tail: int | None = None) -> Column:
    """What the judge sees: text after the first end-of-thinking tag; its last ``tail`` characters
    if given, else all of it."""
    answer_part = F.when(
        F.contains(output, F.lit(THINK_END)),
        strip(F.substr(output, F.instr(output, THINK_END) + len(THINK_END))),
    ).otherwise(output)
    return strip(answer_part if tail is None else F.right(answer_part, F.lit(tail)))


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """Keep about ``max_tokens`` tokens at four characters each; 0 or less keeps all."""
    if max_tokens <= 0:
        return text
    return F.left(text, F.lit(max_tokens * CHARS_PER_TOKEN))


def short_name(path: Column) -> Column:
    """Model name without the organisation or folder before the last slash."""
    return F.substring_index(path, "/", -1)


def lettered_options(question: Column, choices: Column) -> Column:
    """Question followed by ``A. first``, ``B. second`` …; untouched without choices."""
    # the code point after A by its number; char() would wrap at 256
    letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.lit(65) + i), 8, "0")), "UTF-32")
    lines = F.transform(choices, lambda choice, i: F.concat(letter(i), F.lit(". "), choice))
    block = F.concat(question, F.lit("\n\nOptions:\n"), F.array_join(lines, "\n"))
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, strip(block)).otherwise(question)

"""Parsing of the judge's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import strip

# The labels a judge answers with.
CORRECT = "correct"
LABELS = ("correct", "incorrect")


def verdict_label(judgment: Column) -> Column:
    """Stripped lower-case text; a missing judgment counts as empty."""
    return F.lower(strip(F.coalesce(judgment, F.lit(""))))


def is_correct_prefix(judgment: Column) -> Column:
    """Square brackets dropped, then the text must start with the label."""
    bare = F.translate(F.coalesce(judgment, F.lit("")), "[]", "")
    return F.startswith(F.lower(strip(bare)), F.lit(CORRECT))


def is_correct_exact(judgment: Column) -> Column:
    return verdict_label(judgment) == CORRECT


def is_valid(judgment: Column) -> Column:
    return verdict_label(judgment).isin(*LABELS)


MODES = {"prefix": is_correct_prefix, "exact": is_correct_exact}


def is_correct(judgment: Column, mode: str = "prefix") -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown verdict mode {mode!r}, expected one of {tuple(MODES)}")
    return MODES[mode](judgment)

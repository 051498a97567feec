"""Numeric expressions of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int | Column) -> Column:
    """Chance that at least one of k draws out of n attempts, c of them correct, is correct.

    ``1 - C(n-c, k) / C(n, k)`` as a product of k ratios, so no factorial overflows;
    1.0 when fewer than k attempts failed.
    """
    k_col = F.lit(k) if isinstance(k, int) else k
    if isinstance(k, int) and k <= 16:
        all_fail = F.lit(1.0)
        for i in range(k):
            all_fail = all_fail * ((n - c - i) / (n - i))
    else:
        all_fail = F.aggregate(
            F.sequence(F.lit(0), (k_col - 1).cast("int")),
            F.lit(1.0),
            lambda acc, i: acc * ((n - c - i) / (n - i)),
        )
    return F.when(n - c < k_col, F.lit(1.0)).otherwise(F.lit(1.0) - all_fail)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator, denominator).cast("double"), F.lit(0.0))


def token_efficiency(correct: Column, tokens: Column) -> Column:
    """Correct answers per token."""
    return ratio(correct, tokens)

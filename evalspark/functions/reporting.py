"""Number and time formats of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_even(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of non-negative integers, ties to the even neighbour."""
    low = F.call_function("div", numerator, denominator)
    twice_rest = (numerator % denominator) * 2
    up = (twice_rest > denominator) | ((twice_rest == denominator) & (low % 2 == 1))
    return low + F.when(up, 1).otherwise(0)


def _with_point(scaled: Column, digits: int) -> Column:
    base = F.lit(10**digits)
    return F.concat(
        F.call_function("div", scaled, base).cast("string"),
        F.lit("."),
        F.lpad((scaled % base).cast("string"), digits, "0"),
    )


def fixed(number: Column, digits: int) -> Column:
    """Fixed decimals of a ratio or percentage in [0, 512), ties to even.

    ``format_string`` rounds the shortest decimal spelling half up (0.0625 reads 0.063).
    Here the double is scaled by a power of two, which is exact, and rounded as an integer;
    bits below the scale can only lift a tie.
    """
    scale = F.when(number < 1, F.lit(2**62)).otherwise(F.lit(2**53))
    scaled = number * scale.cast("double")
    units = scaled.cast("bigint")
    rest = F.when(units.cast("double") < scaled, 1).otherwise(0)
    numerator = units.cast("decimal(19,0)") * F.lit(2 * 10**digits) + rest
    outside = F.raise_error(F.lit("fixed() takes numbers in [0, 512)")).cast("string")
    return F.when((number < 0) | (number >= 512), outside).otherwise(_with_point(_half_even(numerator, scale.cast("decimal(19,0)") * 2), digits))


def three_decimals(number: Column) -> Column:
    return fixed(number, 3)


def percent(number: Column) -> Column:
    """``0.4567`` as ``45.7%``."""
    return F.concat(fixed(number * 100, 1), F.lit("%"))


def size_kb(length: Column) -> Column:
    """Bytes as kilobytes with one decimal."""
    tenths = _half_even(length.cast("bigint") * 10, F.lit(1024))
    return F.concat(_with_point(tenths, 1), F.lit(" KB"))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

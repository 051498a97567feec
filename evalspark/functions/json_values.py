"""JSON values as VARIANT: presence, truthiness and their Python text.

A field that is absent, a field that is ``null`` and a field that is empty are three
different things to the normalisers, so records are parsed to VARIANT: an absent field is
SQL NULL, a JSON null is a VARIANT null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(record: Column, name: str) -> Column:
    """The field as VARIANT, SQL NULL when absent."""
    return F.try_variant_get(record, f"$.{name}", "variant")


# a string, or a number that only lenient parsers know; possessive, so long texts don't recurse
_STRING_OR_NUMBER = r'(?s)("(?:[^"\\]++|\\.)*+")|(-?Infinity|NaN)'
_NUMBER_TEXTS = {"": "", "NaN": '"nan"', "Infinity": '"inf"', "-Infinity": '"-inf"'}


def strict_json(text: Column) -> Column:
    """The text with ``NaN``, ``Infinity`` and ``-Infinity`` outside strings as the strings nan, inf and -inf.

    Strings keep such words. Texts without them, and those with control characters, which no JSON has, stay as they are.
    """
    marked = F.regexp_replace(text, _STRING_OR_NUMBER, "$1\u0001$2\u0002")
    for number, spelled in _NUMBER_TEXTS.items():
        marked = F.replace(marked, F.lit(f"\u0001{number}\u0002"), F.lit(spelled))
    lenient = (text.contains("NaN") | text.contains("Infinity")) & ~text.contains("\u0001")
    return F.when(lenient, marked).otherwise(text)


def record_of(text: Column) -> Column:
    """The VARIANT of a JSON text, SQL NULL if it can't be parsed; numbers that aren't JSON are their Python text."""
    return F.try_parse_json(strict_json(text))


def json_literal(text: str) -> Column:
    return F.parse_json(F.lit(text))


def first_present(record: Column, *names: str, default: str = '""') -> Column:
    """First field that exists, even if it is null; else the JSON default."""
    return F.coalesce(*[field(record, name) for name in names], json_literal(default))


def kind(value: Column) -> Column:
    """Type name of a VARIANT, e.g. ``STRING``, ``BIGINT``, ``VOID``; NULL when absent."""
    return F.schema_of_variant(value)


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def python_float_text(number: Column) -> Column:
    """``str(float)``: shortest digits, exponent form below 1e-4 and from 1e16 on.

    Java prints the same digits but changes to exponent form at other bounds. A decimal with
    20 places holds every such number between the two bounds exactly as Java spells it.
    """
    size = F.abs(number)
    plain = F.rtrim(number.cast("decimal(38,20)").cast("string"), F.lit("0"))
    java = F.regexp_replace(number.cast("string"), r"\.0E", "E")
    small = F.replace(F.regexp_replace(java, r"E-(\d)$", "E-0$1"), F.lit("E-"), F.lit("e-"))
    return (
        F.when(
            (size == 0) | ((size >= 1e-4) & (size < 1e16)),
            F.regexp_replace(plain, r"\.$", ".0"),
        )
        .when(size < 1, small)
        .otherwise(F.replace(java, F.lit("E"), F.lit("e+")))
    )


def python_text(
    value: Column, null_text: str | None = "None", value_kind: Column | None = None
) -> Column:
    """``str(value)`` of a VARIANT; lists and objects keep their JSON text.

    ``null_text=None`` leaves a JSON null as SQL NULL for fields that are handed on as they are.
    ``value_kind`` is the type name where the caller has computed it.
    """
    k = kind(value) if value_kind is None else value_kind
    long_integer = k.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")
    null_column = F.lit(null_text).cast("string")
    return (
        F.when(k == "STRING", as_string(value))
        .when(k == "VOID", null_column)
        .when(k == "BOOLEAN", F.initcap(as_string(value)))
        .when((k == "BIGINT") | long_integer, as_string(value))
        .when(k.startswith("DECIMAL") | (k == "DOUBLE"), python_float_text(as_double(value)))
        .when(value.isNotNull(), F.to_json(value))
    )


def truthy(value: Column) -> Column:
    """False for absent, null, ``""``, 0, 0.0, false, ``[]`` and ``{}``."""
    k = kind(value)
    return F.coalesce(
        F.when(k == "VOID", F.lit(False))
        .when(k == "STRING", as_string(value) != "")
        .when(k == "BOOLEAN", as_string(value) == "true")
        .when(
            (k == "BIGINT") | k.startswith("DECIMAL") | (k == "DOUBLE"), as_double(value) != 0
        )
        .otherwise(~F.to_json(value).isin("[]", "{}")),
        F.lit(False),
    )

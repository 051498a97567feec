"""Differently shaped benchmark records to one sample table.

Input rows are ``(dataset, split, rec_idx, value)`` with one JSON record in ``value``. The
work is row-local: one parse to VARIANT, then column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import json_values as J
from evalspark.functions.extraction import extract_answer, gsm8k_answer
from evalspark.functions.text import lettered_options
from evalspark.operators.sizes import broadcast_if_small

MALFORMED = "malformed JSON"
NOT_AN_OBJECT = "record is not an object"
NOT_TEXT = "answer is not text"
NOT_A_LIST = "choices is not a list"


@dataclass(frozen=True)
class Layout:
    """Where a dataset keeps its parts; of several field names the first present one counts."""

    prefix: str
    problem: tuple[str, ...]
    answer: tuple[str, ...]
    # how the answer is read: str, raw, or the name of an extraction rule
    answer_rule: str
    metadata: tuple[tuple[str, tuple[str, ...], str], ...]
    choices: tuple[str, ...] = ()


def _kept(*names: str) -> tuple[tuple[str, tuple[str, ...], str], ...]:
    return tuple((name, (name,), '""') for name in names)


# Field names of the supported benchmark files.
LAYOUTS = {
    "math": Layout(
        "math", ("problem",), ("solution",), "math", _kept("level", "type", "solution")
    ),
    "gsm8k": Layout(
        "gsm8k",
        ("question", "problem"),
        ("answer",),
        "gsm8k",
        (("raw_answer", ("answer",), '""'),),
    ),
    "aime": Layout("aime", ("problem", "question"), ("answer",), "str", _kept("year", "contest")),
    "aime25": Layout(
        "aime25", ("problem", "question"), ("answer",), "str", _kept("year", "contest")
    ),
    "olympiadbench": Layout(
        "olympiadbench",
        ("problem", "question"),
        ("answer", "solution"),
        "olympiad",
        _kept("subject", "level", "source", "year", "country", "language"),
    ),
    "mmlu-pro": Layout(
        "mmlu_pro",
        ("question", "problem"),
        ("answer",),
        "raw",
        (
            ("category", ("category", "subject"), '""'),
            ("choices", ("options", "choices"), "[]"),
            ("answer_index", ("answer_index",), "-1"),
            ("difficulty", ("difficulty",), '""'),
        ),
        choices=("options", "choices"),
    ),
    "amc": Layout(
        "amc",
        ("problem", "question"),
        ("answer",),
        "str",
        (
            *_kept("year", "contest", "problem_number"),
            ("choices", ("choices",), "[]"),
        ),
    ),
    "gpqa": Layout(
        "gpqa",
        ("question", "problem"),
        ("correct_answer", "answer"),
        "raw",
        (("choices", ("choices",), "[]"), *_kept("explanation", "domain", "difficulty")),
    ),
    "minerva": Layout(
        "minerva",
        ("problem", "question"),
        ("answer", "solution"),
        "minerva",
        (*_kept("subject", "level"), ("raw_answer", ("answer",), '""')),
    ),
}


Layouts = Mapping[str, Layout]


def _by_dataset(
    layouts: Layouts, key: Callable[[str], Hashable], build: Callable[[Hashable], Column]
) -> Column:
    """One expression per distinct key, chosen by the row's dataset."""
    names_of: dict[Hashable, list[str]] = {}
    for name in layouts:
        names_of.setdefault(key(name), []).append(name)
    if len(names_of) == 1:
        return build(next(iter(names_of)))
    first, *rest = names_of.items()
    chain = F.when(F.col("dataset").isin(first[1]), build(first[0]))
    for value, names in rest:
        chain = chain.when(F.col("dataset").isin(names), build(value))
    return chain


def _metadata(name: str, layout: Layout) -> Column:
    record = F.col("_record")
    fields = [
        J.first_present(record, *names, default=default).alias(key)
        for key, names, default in layout.metadata
    ]
    return F.to_variant_object(F.struct(*fields, J.json_literal(f'"{name}"').alias("dataset")))


def _answer(rule: str) -> Column:
    """The answer from its ``str()`` text in ``_answer_text`` and the JSON type in ``_kind``.

    ``_text`` is the same text where the JSON value is a string, else empty.
    """
    text = F.col("_answer_text")
    if rule == "str":
        return text
    if rule == "raw":
        return F.when(F.col("_kind") != "VOID", text)
    if rule == "gsm8k":
        return F.when(F.col("_kind") == "STRING", gsm8k_answer(F.col("_text"))).otherwise(text)
    return extract_answer(F.col("_text"), rule)


def _not_text(rule: str) -> Column:
    """Values the rule's text search cannot read; Minerva and Olympiad skip empty ones first."""
    other = F.col("_kind") != "STRING"
    if rule == "math":
        return other
    if rule in ("minerva", "olympiad"):
        return other & J.truthy(F.col("_answer"))
    return F.lit(False)


def _choices(names: tuple[str, ...]) -> Column:
    if not names:
        return F.lit(None).cast("variant")
    return J.first_present(F.col("_record"), *names, default="[]")


def normalize_layouts(raw: DataFrame, layouts: Layouts) -> DataFrame:
    """Samples of all named datasets in one pass.

    Unreadable rows have the reason in ``error`` and the raw record in ``value``, both null
    elsewhere. Every step is a projection, so a record is parsed once and nothing is shuffled however
    many datasets the rows belong to.
    """
    record = F.col("_record")
    fields = raw.withColumn("_record", J.record_of(F.col("value"))).withColumns(
        {
            "_problem": _by_dataset(
                layouts, lambda n: layouts[n].problem, lambda f: J.first_present(record, *f)
            ),
            "_answer": _by_dataset(
                layouts, lambda n: layouts[n].answer, lambda f: J.first_present(record, *f)
            ),
            "_choices": _by_dataset(layouts, lambda n: layouts[n].choices, _choices),
            "metadata": _by_dataset(layouts, lambda n: n, lambda n: _metadata(n, layouts[n])),
        }
    )
    typed = fields.withColumns(
        {"_kind": J.kind(F.col("_answer")), "_problem_kind": J.kind(F.col("_problem"))}
    )
    texts = typed.withColumns(
        {
            "problem": J.python_text(F.col("_problem"), None, F.col("_problem_kind")),
            "_answer_text": J.python_text(F.col("_answer"), "None", F.col("_kind")),
        }
    )
    texts = texts.withColumn(
        "_text", F.when(F.col("_kind") == "STRING", F.col("_answer_text")).otherwise(F.lit(""))
    )
    error = (
        F.when(record.isNull(), MALFORMED)
        .when(~F.startswith(F.ltrim("value"), F.lit("{")), NOT_AN_OBJECT)
        .when(_by_dataset(layouts, lambda n: layouts[n].answer_rule, _not_text), NOT_TEXT)
    )
    problem = F.col("problem")
    if any(layout.choices for layout in layouts.values()):
        filled, choices = J.truthy(F.col("_choices")), F.col("_choices")
        items = F.transform(
            F.try_variant_get(choices, "$", "array<variant>"), lambda item: J.python_text(item)
        )
        problem = F.when(
            filled, lettered_options(F.coalesce(problem, F.lit("None")), items)
        ).otherwise(problem)
        error = error.when(filled & ~F.startswith(J.kind(choices), F.lit("ARRAY")), NOT_A_LIST)
    prefix = _by_dataset(layouts, lambda n: layouts[n].prefix, F.lit)
    samples = texts.select(
        "dataset",
        "split",
        F.concat_ws("_", prefix, "split", "rec_idx").alias("id"),
        problem.alias("problem"),
        _by_dataset(layouts, lambda n: layouts[n].answer_rule, _answer).alias("answer"),
        "metadata",
        error.alias("error"),
        "value",
    )
    return samples.withColumn("value", F.when(F.col("error").isNotNull(), F.col("value")))


Normalizer = Callable[[DataFrame], DataFrame]

REGISTRY: dict[str, Layout | Normalizer] = dict(LAYOUTS)


def register_dataset(name: str, normalizer: Layout | Normalizer) -> None:
    """Add a dataset: a layout, or a function from raw rows to sample rows."""
    REGISTRY[name] = normalizer


def normalize_many(raw: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Samples of the rows of the named datasets; layouts share one pass over the rows."""
    unknown = [name for name in datasets if name not in REGISTRY]
    if unknown:
        raise ValueError(f"Unsupported dataset: {', '.join(unknown)}")
    layouts = {n: REGISTRY[n] for n in datasets if isinstance(REGISTRY[n], Layout)}
    parts = [
        REGISTRY[n](raw.filter(F.col("dataset") == n)) for n in datasets if n not in layouts
    ]
    if layouts:
        known = raw.filter(F.col("dataset").isin(list(layouts)))
        parts.insert(0, normalize_layouts(known, layouts))
    return reduce(DataFrame.unionByName, parts)


def normalize(raw: DataFrame, dataset: str) -> DataFrame:
    """All rows as samples of one dataset."""
    return normalize_many(raw.withColumn("dataset", F.lit(dataset)), [dataset])


def good_samples(normalized: DataFrame, strict: bool = False) -> DataFrame:
    """Readable samples. ``strict`` drops every dataset split with an unreadable row.

    Best read from a written table: on rows still to be computed the filter is pushed below
    the projections and parses each record again.
    """
    good = normalized.filter(F.col("error").isNull()).drop("error", "value")
    if not strict:
        return good
    failed = (
        normalized.groupBy("dataset", "split")
        .agg(F.count_if(F.col("error").isNotNull()).alias("_bad"))
        .filter(F.col("_bad") > 0)
    )
    return good.join(broadcast_if_small(failed), ["dataset", "split"], "left_anti")


def quarantine(normalized: DataFrame) -> DataFrame:
    """Unreadable records with the reason."""
    return normalized.filter(F.col("error").isNotNull()).select(
        "dataset", "split", "id", "error", "value"
    )


# Names a generic record may use for its three standard fields.
GENERIC_FIELDS = {
    "question": ("question", "problem", "input", "query"),
    "answer": ("answer", "solution", "target", "output"),
    "id": ("id", "idx", "index", "problem_id"),
}


def standardize(raw: DataFrame, keep: Sequence[str] = ("dataset",)) -> DataFrame:
    """Generic records to ``question, answer, id, metadata``; other fields go to metadata.

    Metadata values are text: strings as they are, anything else as JSON.
    """
    known = [name for names in GENERIC_FIELDS.values() for name in names]
    record = F.col("_record")
    parsed = raw.withColumn("_record", J.record_of(F.col("value")))
    leftovers = F.map_filter(
        F.when(record.isNotNull(), F.from_json(J.strict_json(F.col("value")), "map<string,string>")),
        lambda key, _: ~key.isin(*known),
    )
    return parsed.select(
        *keep,
        *[
            J.python_text(J.first_present(record, *names), null_text=None).alias(standard)
            for standard, names in GENERIC_FIELDS.items()
        ],
        leftovers.alias("metadata"),
        F.when(record.isNull(), MALFORMED).alias("error"),
    )

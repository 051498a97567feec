"""Conversations as training text, in Spark expressions only.

Turns are collected as structs by conversation, sorted, and adjacent turns of one role merged to a run. A run is
written between a mark that names its role and a closing mark, its turns with a mark between them. Marks inside
texts and roles are escaped, so the text can be read back turn for turn. The loss mask is a list of byte spans,
one for each learned turn: its text without any mark.

A conversation longer than ``part_turns`` turn numbers comes in parts, so that no task gathers a long one; what
a part's first mark and last mark are follows from the roles at the ends of its neighbours, which are found
without moving texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
# positions are summed in chunks of so many turns, as an array that grows by one is copied each time
CHUNK = 256
SPANS = "array<struct<start:bigint,length:bigint>>"
NULL_ROLE = "\\z"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn; all begin with one character, which they have nowhere else."""

    opening: str = "<turn "
    named: str = ">"
    between: str = "<and/>"
    closing: str = "</turn>"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.opening, self.between, self.closing)
        first = {m[:1] for m in marks}
        if "\\" in "".join(marks) + self.named or len(first) != 1 or len(self.named) != 1:
            raise ValueError("marks have no backslash and one first character, a name ends with one character")
        if any(a is not b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no mark begins with another one")
        if "" in first or any(first & set(m[1:]) for m in marks) or self.named in self.opening:
            raise ValueError("a mark has its first character once, an opening not the character that ends a name")

    def codes(self) -> list[tuple[str, str]]:
        """What is replaced in a text, in this order, by what; the code of a backslash comes first."""
        return [("\\", "\\b"), (self.opening, "\\o"), (self.between, "\\a"), (self.closing, "\\c")]


def escaped(text: Column, template: ChatTemplate) -> Column:
    """The text without marks: a backslash begins a code of two characters."""
    for plain, code in template.codes():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: ChatTemplate) -> Column:
    for plain, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_name(role: Column, template: ChatTemplate) -> Column:
    name = F.replace(escaped(role, template), F.lit(template.named), F.lit("\\g"))
    return F.coalesce(name, F.lit(NULL_ROLE))


def _role_of(name: Column, template: ChatTemplate) -> Column:
    role = unescaped(F.replace(name, F.lit("\\g"), F.lit(template.named)), template)
    return F.when(name != NULL_ROLE, role)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(turns: Column) -> Column:
    """Sorted turns with adjacent ones of a role merged: ``role`` and its ``texts``."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]),
    )

    def run(starts: Column, start: Column, number: Column) -> Column:
        end = F.coalesce(F.get(starts, number + 1), F.size(turns))
        members = F.slice(turns, start + 1, end - start)
        return F.struct(
            F.get(turns, start)["role"].alias("role"),
            F.transform(members, lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"),
        )

    return let(starts, lambda s: F.transform(s, lambda start, number: run(s, start, number)))


def _pieces(runs: Column, continues: Column, template: ChatTemplate) -> Column:
    """For every turn the marks before it (``lead``), its escaped text and whether it is learned."""

    def turns_of(run: Column, number: Column) -> Column:
        opening = F.concat(
            F.when(number > 0, F.lit(template.closing)).otherwise(F.lit("")),
            F.lit(template.opening),
            _role_name(run["role"], template),
            F.lit(template.named),
        )
        goes_on = (number == 0) & continues
        learned = F.coalesce(run["role"].isin(*template.learned), F.lit(False))
        return F.transform(
            run["texts"],
            lambda text, i: F.struct(
                F.when((i > 0) | goes_on, F.lit(template.between)).otherwise(opening).alias("lead"),
                escaped(text, template).alias("body"),
                learned.alias("learned"),
            ),
        )

    return F.flatten(F.transform(runs, turns_of))


def _spans(pieces: Column) -> Column:
    """Start and length, in bytes of UTF-8, of every learned text."""
    none = F.array().cast(SPANS)

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.octet_length(piece["lead"])
        length = F.octet_length(piece["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length"))).cast(SPANS)
        spans = F.when(piece["learned"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + length).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    chunks = F.transform(
        F.sequence(F.lit(1), F.size(pieces), F.lit(CHUNK)),
        lambda i: F.aggregate(F.slice(pieces, i, F.lit(CHUNK)), begin, add),
    )

    def moved(chunks: Column) -> Column:
        offsets = F.aggregate(
            chunks,
            F.array(F.lit(0).cast("bigint")),
            lambda seen, c: F.concat(seen, F.array(F.element_at(seen, -1) + c["at"])),
        )
        return let(
            offsets,
            lambda offset: F.flatten(
                F.transform(
                    chunks,
                    lambda c, i: F.transform(
                        c["spans"],
                        lambda s: F.struct(
                            (s["start"] + F.get(offset, i)).alias("start"), s["length"].alias("length")
                        ),
                    ),
                )
            ),
        )

    return let(chunks, moved)


def _part(part_turns: int) -> Column:
    """Part of a turn by its number; null and negative numbers are in the first."""
    turn = F.greatest(F.coalesce(F.col("turn").cast("bigint"), F.lit(0)), F.lit(0))
    return F.floor(turn / part_turns)


def format_conversations(
    turns: DataFrame, template: ChatTemplate = ChatTemplate(), part_turns: int = PART_TURNS
) -> DataFrame:
    """``conv_id, part, last_part, text, loss_spans`` of conversations given as rows of turns.

    The texts of a conversation's parts, in order, are its formatted text; almost all have one part, number 0.
    ``loss_spans`` are byte spans of the part's text: the escaped text of each learned turn.

    Rows of a conversation are ordered by ``turn`` (null first), then by role and text, so ties and repeated rows
    have one defined order; all of them are kept. A null text is the empty text. A null role is a role of its own.
    Rows with a null conv_id are one conversation. Other columns are ignored. An empty table gives an empty table.
    The texts are shuffled once, by conversation and part. Rows that share one turn number stay in one part.
    """
    # as a struct, a null conv_id equals itself in joins, and the parts stay where they were grouped
    rows = turns.select(
        F.struct("conv_id").alias("key"), "turn", "role", "text", _part(part_turns).alias("part")
    )
    place = F.struct("turn", "role")
    ends = rows.groupBy("key", "part").agg(
        F.min(place)["role"].alias("first_role"), F.max(place)["role"].alias("last_role")
    )
    order = Window.partitionBy("key").orderBy("part")
    before, after = F.lag("part").over(order), F.lead("part").over(order)
    beside = ends.select(
        "key",
        "part",
        before.isNotNull().alias("_not_first"),
        after.isNotNull().alias("_not_last"),
        (before.isNotNull() & F.lag("last_role").over(order).eqNullSafe(F.col("first_role"))).alias("_continues"),
        (after.isNotNull() & F.lead("first_role").over(order).eqNullSafe(F.col("last_role"))).alias("_continued"),
    ).where("_not_first OR _not_last")
    parts = rows.groupBy("key", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    placed = parts.join(beside, ["key", "part"], "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    # a part goes on with its predecessor's last run, or closes that run first
    first_mark = F.when(flag("_not_first") & ~flag("_continues"), F.lit(template.closing)).otherwise(F.lit(""))
    pieces = let(F.col("turns"), lambda t: let(_runs(t), lambda r: _pieces(r, flag("_continues"), template)))

    def written(pieces: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["lead"], p["body"])), "")
        closing = F.when(flag("_not_last"), F.lit("")).otherwise(F.lit(template.closing))
        return F.struct(
            F.concat(first_mark, text, closing).alias("text"), _spans(pieces).alias("loss_spans")
        )

    whole = placed.select(
        F.col("key.conv_id").alias("conv_id"),
        "part",
        (~flag("_not_last")).alias("last_part"),
        F.octet_length(first_mark).alias("_offset"),
        let(pieces, written).alias("_written"),
    )
    return whole.select(
        "conv_id",
        "part",
        "last_part",
        F.col("_written.text").alias("text"),
        F.transform(
            "_written.loss_spans",
            lambda s: F.struct((s["start"] + F.col("_offset")).alias("start"), s["length"].alias("length")),
        ).alias("loss_spans"),
    )


def read_turns(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, structs of role and text in order, of a whole conversation's formatted text."""

    def quoted(mark: str) -> str:
        return rf"\Q{mark}\E"

    def turns_of(run: Column) -> Column:
        name = F.substring_index(run, template.named, 1)
        role = _role_of(F.substring(name, len(template.opening) + 1, 1 << 30), template)
        body = F.substr(run, F.char_length(name) + 2)
        return F.transform(
            F.split(body, quoted(template.between)),
            lambda t: F.struct(role.alias("role"), unescaped(t, template).alias("text")),
        )

    # behind the last closing mark nothing follows
    runs = F.split(text, quoted(template.closing))
    return F.flatten(let(runs, lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), turns_of)))


def read_learned(text: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under a part's loss mask, unescaped, nothing between the turns."""

    def cut(raw: Column, span: Column) -> Column:
        piece = F.substring(raw, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return unescaped(piece.cast("string"), template)

    return let(text.cast("binary"), lambda raw: F.array_join(F.transform(spans, lambda s: cut(raw, s)), ""))


def conversation_digests(parts: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation what its formatted parts hold, read back from their texts and masks.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; a null role reads as the empty one.
    Only the parts of conversations that have several move; there a digest needs the whole text.
    """
    def line(turn: Column) -> Column:
        return F.concat(F.coalesce(turn["role"], F.lit("")), F.lit("\n"), turn["text"], F.lit("\n"))

    def digests(text: Column, learned: Column) -> Column:
        return let(
            read_turns(text, template),
            lambda turns: F.struct(
                F.size(turns).cast("bigint").alias("n_turns"),
                F.sha2(F.array_join(F.transform(turns, line), ""), 256).alias("turns_sha256"),
                F.char_length(learned).cast("bigint").alias("loss_chars"),
                F.sha2(learned, 256).alias("loss_sha256"),
                F.char_length(text).cast("bigint").alias("formatted_chars"),
            ),
        )

    alone = F.col("last_part") & (F.col("part") == 0)
    read = F.struct("part", "text", read_learned(F.col("text"), F.col("loss_spans"), template).alias("learned"))
    marked = parts.select(
        "conv_id",
        let(read, lambda p: F.when(alone, digests(p["text"], p["learned"]))).alias("alone"),
        F.when(~alone, read).alias("piece"),
    )
    grouped = marked.groupBy("conv_id").agg(
        F.max("alone").alias("alone"), F.sort_array(F.collect_list("piece")).alias("pieces")
    )
    text, learned = (F.array_join(F.transform("pieces", lambda p: p[f]), "") for f in ("text", "learned"))
    return grouped.select(
        "conv_id", F.coalesce("alone", digests(text, learned)).alias("read")
    ).select("conv_id", "read.*")

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm import chat_format
from evalspark.llm.chat_format import ChatTemplate, conversation_digests, format_conversations, read_turns

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
MARKS = ["<turn ", "<turn user>", "<and/>", "</turn>", "\\", "\\b", "\\c", "\\z", "<", ">", "a\n", "é", "\U0001f389", " "]


def by_conversation(rows):
    def key(r):
        return tuple((v is not None, v) for v in (r[1], r[2], r[3]))

    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2], r[3] or ""))
    return out


def brute_text(turns, template):
    def esc(text):
        for plain, code in template.codes():
            text = text.replace(plain, code)
        return text

    out = ""
    for role, members in itertools.groupby(turns, key=lambda t: t[0]):
        name = "\\z" if role is None else esc(role).replace(template.named, "\\g")
        texts = template.between.join(esc(t) for _, t in members)
        out += f"{template.opening}{name}{template.named}{texts}{template.closing}"
    return out


def brute_digest(turns, template):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = "".join(t for r, t in turns if r in template.learned)
    whole = "".join(f"{r or ''}\n{t}\n" for r, t in turns)
    return (len(turns), sha(whole), len(learned), sha(learned), len(brute_text(turns, template)))


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", None, "a>b</turn>\\g", ""]
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.randrange(1, most)):
            text = None if rng.random() < 0.1 else "".join(rng.choices(MARKS, k=rng.randrange(8)))
            turn = None if rng.random() < 0.05 else rng.randrange(-2, most)
            rows.append((conv, turn, rng.choice(roles), text))
    return rows + rows[:5]


@pytest.mark.parametrize("part_turns", [1, 4, 256])
@pytest.mark.parametrize("template", [ChatTemplate(), ChatTemplate("#: ", "\n", "#+", "#.", ("assistant", "user"))])
def test_read_back(spark, template, part_turns):
    rows = random_rows(part_turns, 40, 30)
    parts = format_conversations(
        spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("own")), template, part_turns
    )
    want = by_conversation(rows)
    texts = {}
    for r in parts.orderBy("conv_id", "part").collect():
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        raw = r["text"].encode()
        for s in r["loss_spans"]:
            assert not any(m in raw[s["start"] : s["start"] + s["length"]].decode() for m in (template.opening, template.closing))
    assert texts == {conv: brute_text(turns, template) for conv, turns in want.items()}
    got = {r[0]: tuple(r[1:]) for r in conversation_digests(parts, template).collect()}
    assert got == {conv: brute_digest(turns, template) for conv, turns in want.items()}


def test_turns_come_back(spark):
    rows = random_rows(9, 20, 12)
    parts = format_conversations(spark.createDataFrame(rows, TURNS))
    read = parts.select("conv_id", read_turns(F.col("text")).alias("turns")).collect()
    assert {r[0]: [tuple(t) for t in r[1]] for r in read} == by_conversation(rows)


def test_other_marks(spark):
    for marks in (("### ", ":", "##+", "##."), ("<a>", ">", "<b", "<c"), ("<a", ">", "b", "<c"), ("<a\\", ">", "<b", "<c"), ("<a", ">", "<b", "<bc")):
        with pytest.raises(ValueError):
            ChatTemplate(*marks)
    template = ChatTemplate("[role=", "]", "[next]", "[end]", ("bot",))
    rows = [(1, 0, "bot", "[end] x [role=bot] [ ]"), (1, 1, "bot", ""), (1, 2, "user]", None)]
    parts = format_conversations(spark.createDataFrame(rows, TURNS), template)
    assert parts.first()["text"] == brute_text(by_conversation(rows)[1], template)
    got = {r[0]: tuple(r[1:]) for r in conversation_digests(parts, template).collect()}
    assert got == {1: brute_digest(by_conversation(rows)[1], template)}


def test_long_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 7)
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"turn {i} \\") for i in range(2_000)]
    rows += [(2, 0, "assistant", f"same number {i:04}") for i in range(500)]
    parts = format_conversations(spark.createDataFrame(rows, TURNS), part_turns=64)
    assert parts.where("conv_id = 1").count() == 32
    got = {r[0]: tuple(r[1:]) for r in conversation_digests(parts).collect()}
    assert got == {c: brute_digest(t, ChatTemplate()) for c, t in by_conversation(rows).items()}


def test_long_text_and_empty_table(spark):
    text = "long </turn> \\ é " * 100_000
    rows = [(3, 0, "user", "q"), (3, 1, "assistant", text)]
    got = conversation_digests(format_conversations(spark.createDataFrame(rows, TURNS))).first()
    assert tuple(got)[1:] == brute_digest(by_conversation(rows)[3], ChatTemplate())
    empty = format_conversations(spark.createDataFrame([], TURNS))
    assert empty.count() == 0 and conversation_digests(empty).count() == 0


def test_expressions_only(spark):
    parts = format_conversations(spark.createDataFrame([(1, 0, "user", "a")], TURNS))
    plan = conversation_digests(parts)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import extraction, json_values, prompts, reporting, scoring, text, verdicts


def apply(spark, values, fn, schema="v string"):
    """Results of a column function, in input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    got = df.select("i", fn(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(got, key=lambda r: r.i)]


def test_strip_matches_python(spark):
    values = ["", " ", " x　", "\x1cx\x1f", "\r\na b\t\n", "x", "​x​", "é ", "😀\x85"]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("x</think>y</think>z", "y</think>z"),
        ("think</think>  42 \n", "42"),
        ("plain ", "plain"),
        ("", ""),
        ("</think>", ""),
        ("a" * 5 + "😀" * 1000, "😀" * 1000),
        (" " + "b" * 999 + "  ", ("b" * 999 + "  ")[-1000:].strip()),
        ("t</think>" + "q " * 600, ("q " * 600).strip()[-1000:].strip()),
    ],
)
def test_clean_output(spark, raw, want):
    assert apply(spark, [raw], lambda c: text.clean_output(c, 1000)) == [want]


def test_truncate(spark):
    v = "😀bcdefghij"
    assert apply(spark, [v], lambda c: text.truncate_tokens(c, 2)) == [v[:8]]
    assert apply(spark, [v], lambda c: text.truncate_tokens(c, 0)) == [v]
    assert apply(spark, [v], lambda c: text.truncate_tokens(c, -3)) == [v]


def test_short_name(spark):
    assert apply(spark, ["a/b/c", "c", "a/"], text.short_name) == ["c", "c", ""]


def test_options(spark):
    got = apply(
        spark,
        [["x", "y "], [], None],
        lambda c: text.lettered_options(F.lit("Q?"), c),
        "v array<string>",
    )
    assert got == ["Q?\n\nOptions:\nA. x\nB. y", "Q?", "Q?"]


EXPECTED = {
    "general": [
        (r"\boxed{}", ""),
        (r"so \boxed{7} or \boxed{8}", "7"),
        (r"\boxed{\frac{1}{2}}", r"\frac{1"),
        ("The answer is: 42\nmore", "42"),
        ("the answer is   x y \r\nmore", "x y"),
        ("Final answer:\n\n 7", "7"),
        ("Answer:\n\n 7", "7"),
        ("Answer:", ":"),
        ("Answer: ", ""),
        ("Therefore, x\r\ny", "x"),
        ("therefore z", "z"),
        ("Answer: 1 then The answer is 2", "2"),
        ("  no phrase 　", "no phrase"),
        ("", ""),
    ],
    "output": [("Therefore, x", "Therefore, x"), ("final answer 3", "3")],
    "minerva": [("", ""), (None, ""), ("Answer: q", "q")],
    "olympiad": [
        (None, ""),
        ("Solution: s\nAnswer: a", "a"),
        ("Solution: s\nTherefore t", "s"),
        ("therefore t", "t"),
        ("The answer is: 5", "is: 5"),
    ],
    "math": [("l1\n l2 \n\n", "l2"), (r"\boxed{a\nb} x", r"a\nb"), ("one", "one"), ("", "")],
    "gsm8k": [
        ("a #### 1 #### 1,234 ", "1234"),
        ("a#####b", "#b"),
        ("no number ", "no number"),
        ("a 1 b -2.5", "-2.5"),
        ("3. and 4.", "4"),
        ("####", ""),
    ],
}


@pytest.mark.parametrize("rule", extraction.RULES)
def test_extraction(spark, rule):
    inputs = [v for v, _ in EXPECTED[rule]]
    got = apply(spark, inputs, lambda c: extraction.extract_answer(c, rule))
    assert got == [want for _, want in EXPECTED[rule]]


def test_extraction_unknown_rule():
    with pytest.raises(ValueError):
        extraction.extract_answer(None, "nope")


def test_python_text(spark):
    raws = [
        "27.0", "27", "1e20", "0.1", "12345678.25", '"x"', "null", "true", "false", "1e-7",
        "0.0001", "0.00001", "1e16", "123456789012345.5", "9999999999999998.0",
        "123456789012345678901234567890", "-2.5e-9", "0.0", "100000000.0", "1.5e300", "-12345678.5",
        "0.000123",
    ]
    got = apply(spark, raws, lambda c: json_values.python_text(F.try_parse_json(c)))
    assert got == [str(json.loads(r)) for r in raws]
    nested = apply(spark, ['[1,"a"]'], lambda c: json_values.python_text(F.try_parse_json(c)))
    assert nested == ['[1,"a"]']


def test_truthy(spark):
    raws = ['""', "0", "0.0", "false", "[]", "{}", "null", '" "', "1", "-0.5", "true", "[0]", '{"a":1}', '"0"']
    got = apply(spark, raws, lambda c: json_values.truthy(F.try_parse_json(c)))
    assert got == [bool(json.loads(r)) for r in raws]


def test_verdicts(spark):
    values = ["Correct", "[Correct]", "[Incorrect]", "correct.", "Incorrect", "", None, " CORRECT\n", "in[correct]"]
    prefix = apply(spark, values, verdicts.is_correct_prefix)
    assert prefix == [True, True, False, True, False, False, False, True, False]
    exact = apply(spark, values, verdicts.is_correct_exact)
    assert exact == [True, False, False, False, False, False, False, True, False]
    valid = apply(spark, values, verdicts.is_valid)
    assert valid == [True, False, False, False, True, False, False, True, False]


def test_prompts(spark):
    got = apply(spark, ["2+2?"], lambda c: prompts.judge_prompt(c, F.lit("a {answer} b"), F.lit(None)))[0]
    assert 'Question: """2+2?"""' in got and "a {answer} b" in got and "Correct answer: None" in got
    p = "Let's reason step by step, and put your final answer within \\boxed{}."
    assert apply(spark, ["x"], prompts.math_prompt) == [f"Problem: x\n\n{p}"]
    assert apply(spark, ["x"], lambda c: prompts.math_prompt(c, "S")) == [f"S\n\nProblem: x\n\n{p}"]
    assert apply(spark, ["x"], lambda c: prompts.math_prompt(c, "")) == [f"Problem: x\n\n{p}"]
    chat = apply(spark, ["x"], lambda c: prompts.chat_messages(c, "S"))[0]
    assert [(m.role, m.content) for m in chat] == [("system", "S"), ("user", f"x\n\n{p}")]
    chat = apply(spark, ["x"], prompts.chat_messages)[0]
    assert [m.role for m in chat] == ["user"]
    assert apply(spark, ["q"], lambda c: prompts.render_template(F.lit("<{query}>"), c)) == ["<q>"]


def test_pass_at_k_against_comb(spark):
    cases = [(n, c, k) for n in range(0, 41) for c in range(0, n + 1) for k in range(1, 11)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    unrolled = F.lit(None).cast("double")
    for k in range(1, 11):
        unrolled = F.when(F.col("k") == k, scoring.pass_at_k(F.col("n"), F.col("c"), k)).otherwise(unrolled)
    rows = df.select(
        "*", scoring.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p"), unrolled.alias("u")
    ).collect()
    for r in rows:
        want = 1.0 if r.n - r.c < r.k else 1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k)
        assert abs(r.p - want) < 1e-12 and abs(r.u - want) < 1e-12, r


def test_fixed_rounds_like_python(spark):
    rng = random.Random(3)
    values = [0.0625, 0.1875, 0.0005, 0.0015, 0.0025, 0.5, 1.0, 0.0, 0.9995, 0.99949999, 1e-5, 2 / 3, 99.95, 12.25, 0.3125]
    values += [rng.randrange(0, 2001) / 2000 for _ in range(400)] + [rng.random() for _ in range(200)]
    got = apply(spark, values, reporting.three_decimals, "v double")
    assert got == [f"{v:.3f}" for v in values]
    got = apply(spark, values, lambda c: reporting.fixed(c, 1), "v double")
    assert got == [f"{v:.1f}" for v in values]
    ratios = [v for v in values if v <= 1]
    assert apply(spark, ratios, reporting.percent, "v double") == [f"{v:.1%}" for v in ratios]
    sizes = [0, 1, 51, 52, 1024, 1075, 1126, 128, 384, 10**9 + 256, 2**50 + 333]
    assert apply(spark, sizes, reporting.size_kb, "v bigint") == [f"{s / 1024:.1f} KB" for s in sizes]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": NaN}', '{"a": "nan"}'),
        ('[-Infinity,Infinity, 1]', '["-inf","inf", 1]'),
        ('{"a": "NaN, \\" Infinity"}', '{"a": "NaN, \\" Infinity"}'),
        ('{"NaN": "\\\\", "b": NaN}', '{"NaN": "\\\\", "b": "nan"}'),
        ('{"a": 1}', '{"a": 1}'),
        ('{"a": "\u0001", "b": NaN}', '{"a": "\u0001", "b": NaN}'),
        ('{"a": NaN', '{"a": "nan"'),
        ('{"a": "' + 'x\\"' * 50_000 + '", "b": Infinity}', '{"a": "' + 'x\\"' * 50_000 + '", "b": "inf"}'),
    ],
)
def test_strict_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(json_values.strict_json(F.col("t"))).first()[0]
    assert got == want


def brute_boxed(text):
    start = text.find("\\boxed{")
    if start < 0:
        return None
    depth, i = 1, start + 7
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 7 : i]
        i += 1
    return None


def test_balanced_boxed(spark):
    rng = random.Random(2)
    pieces = ["\\boxed{", "{", "}", "}", "\\", "\\{", "\\}", "x", "é\n", "\\frac{1}{2}", "🎉"]
    values = ["", "\\boxed{}", "\\boxed{\\frac{1}{2}}", "\\boxed{a", "\\boxed{a\\", "\\boxed{" + "{" * 3000 + "}" * 3001]
    values += ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(400)]
    want = [brute_boxed(v) for v in values]
    assert apply(spark, values, extraction.balanced_boxed) == want
    assert sum(w is not None for w in want) > 50
    got = apply(spark, values, lambda c: extraction.extract_answer(c, "math", balanced=True))
    simple = apply(spark, values, lambda c: extraction.extract_answer(c, "math"))
    assert all(g == w for g, w in zip(got, want) if w is not None)
    assert all(g == s for g, s, v in zip(got, simple, values) if "boxed" not in v)
    assert apply(spark, [None], extraction.balanced_boxed) == [None]

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators.normalize import (
    LAYOUTS,
    REGISTRY,
    Layout,
    good_samples,
    normalize,
    normalize_many,
    quarantine,
    register_dataset,
    standardize,
)


def raw(spark, values, dataset="x", split="test"):
    rows = [(dataset, split, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, split string, rec_idx bigint, value string")


CASES = {
    "math": [
        ({"problem": "p", "solution": r"a \boxed{7} b"}, ("p", "7")),
        ({"solution": "line\n last \n"}, ("", "last")),
        ({"problem": None}, (None, "")),
    ],
    "gsm8k": [
        ({"question": "q", "problem": "p", "answer": "x #### 1,000"}, ("q", "1000")),
        ({"problem": "p", "answer": 27.0}, ("p", "27.0")),
        ({"question": None, "problem": "p", "answer": None}, (None, "None")),
        ({"answer": "is -3 or 4.5"}, ("", "4.5")),
    ],
    "aime": [
        ({"question": "q", "answer": 1e20}, ("q", "1e+20")),
        ({"problem": "", "question": "q", "answer": True}, ("", "True")),
        ({"problem": "p"}, ("p", "")),
        ({"problem": "p", "answer": None}, ("p", "None")),
    ],
    "olympiadbench": [
        ({"problem": "p", "answer": "", "solution": "Answer: 3"}, ("p", "")),
        ({"problem": "p", "answer": None, "solution": "Answer: 3"}, ("p", "")),
        ({"problem": "p", "solution": "Answer: 3"}, ("p", "3")),
        ({"problem": "p", "answer": []}, ("p", "")),
    ],
    "mmlu-pro": [
        (
            {"question": "q", "options": ["x", 2.50, None, False], "answer": "A"},
            ("q\n\nOptions:\nA. x\nB. 2.5\nC. None\nD. False", "A"),
        ),
        ({"question": " q ", "options": [], "choices": ["x"], "answer": 1}, (" q ", "1")),
        ({"problem": "p", "options": None, "choices": ["x"], "answer": None}, ("p", None)),
    ],
    "amc": [({"problem": "p", "answer": 27.0}, ("p", "27.0")), ({"question": "q", "answer": 27}, ("q", "27"))],
    "gpqa": [
        ({"question": "q", "correct_answer": None, "answer": "x"}, ("q", None)),
        ({"problem": "p", "answer": "x"}, ("p", "x")),
    ],
    "minerva": [
        ({"problem": "p", "answer": 0, "solution": "s"}, ("p", "")),
        ({"problem": "p", "solution": "the answer is 5\nx"}, ("p", "5")),
    ],
}


@pytest.mark.parametrize("dataset", CASES)
def test_layouts(spark, dataset):
    records = [json.dumps(r) for r, _ in CASES[dataset]]
    rows = normalize(raw(spark, records), dataset).orderBy("id").collect()
    assert [(r.problem, r.answer) for r in rows] == [want for _, want in CASES[dataset]]
    prefix = dataset.replace("-", "_")
    assert [r.id for r in rows] == [f"{prefix}_test_{i}" for i in range(len(rows))]
    assert all(r.error is None and r.value is None for r in rows)


def test_metadata(spark):
    rows = normalize(raw(spark, ['{"category":"c","subject":"s"}', '{"subject":null}']), "mmlu-pro")
    got = rows.orderBy("id").select(F.to_json("metadata").alias("m")).collect()
    assert [json.loads(r.m) for r in got] == [
        {"category": "c", "choices": [], "answer_index": -1, "difficulty": "", "dataset": "mmlu-pro"},
        {"category": None, "choices": [], "answer_index": -1, "difficulty": "", "dataset": "mmlu-pro"},
    ]


def test_errors_and_quarantine(spark):
    values = ["{bad", "[1]", '{"solution": 5}', '{"solution": null}', '{"solution": "s"}']
    rows = normalize(raw(spark, values), "math")
    errors = {r.value: r.error for r in quarantine(rows).collect()}
    assert errors == {
        "{bad": "malformed JSON",
        "[1]": "record is not an object",
        '{"solution": 5}': "answer is not text",
        '{"solution": null}': "answer is not text",
    }
    assert good_samples(rows).count() == 1
    assert good_samples(rows, strict=True).count() == 0
    bad = normalize(raw(spark, ['{"options": "abc"}', '{"options": 3}']), "mmlu-pro")
    assert {r.error for r in bad.collect()} == {"choices is not a list"}
    # a truthy answer that is no text cannot be searched, an empty one is skipped
    rows = normalize(raw(spark, ['{"answer": [1]}', '{"answer": {}}']), "minerva").orderBy("id")
    assert [r.error for r in rows.collect()] == ["answer is not text", None]


def test_many_equals_one_by_one(spark):
    parts, singles = [], []
    for name, cases in CASES.items():
        part = raw(spark, [json.dumps(r) for r, _ in cases], name)
        parts.append(part)
        singles += normalize(part, name).select("dataset", "id", "problem", "answer", F.to_json("metadata")).collect()
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    many = normalize_many(both, list(CASES)).select("dataset", "id", "problem", "answer", F.to_json("metadata"))
    assert sorted(map(str, many.collect())) == sorted(map(str, singles))


def test_registry(spark):
    with pytest.raises(ValueError, match="Unsupported dataset: nope"):
        normalize(raw(spark, []), "nope")
    register_dataset("mine", Layout("mine", ("ask",), ("reply",), "str", ()))
    register_dataset(
        "other", lambda rows: normalize_many(rows.withColumn("dataset", F.lit("amc")), ["amc"])
    )
    try:
        got = normalize(raw(spark, ['{"ask":"a","reply":1}']), "mine").first()
        assert (got.id, got.problem, got.answer) == ("mine_test_0", "a", "1")
        assert normalize(raw(spark, ['{"problem":"a"}']), "other").first().id == "amc_test_0"
    finally:
        del REGISTRY["mine"], REGISTRY["other"]


def test_standardize(spark):
    values = [
        '{"query":"q","input":"i","target":1.50,"idx":null,"id":4,"a":"x","b":{"c":1},"d":null}',
        "{}",
        "{bad",
    ]
    rows = standardize(raw(spark, values), keep=("rec_idx",)).orderBy("rec_idx").collect()
    first = rows[0]
    assert (first.question, first.answer, first.id) == ("i", "1.5", "4")
    assert first.metadata == {"a": "x", "b": '{"c":1}', "d": None}
    assert (rows[1].question, rows[1].answer, rows[1].id, rows[1].metadata) == ("", "", "", {})
    assert rows[2].error == "malformed JSON"


def test_plan_has_no_shuffle_and_no_python(spark):
    rows = normalize_many(raw(spark, ["{}"], "math"), list(LAYOUTS))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

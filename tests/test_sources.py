import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.sources import catalogue
from evalspark.sources.json_array import read_json_array, sample_json_array
from evalspark.sources.jsonl import _block_table, _scan, number_lines, read_jsonl, read_split
from evalspark.sources.responses import load_responses
from evalspark.sinks.tables import save_by_dataset, save_jsonl


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def numbered(text):
    """(line number, record number, line) of the non-blank lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    kept = [(i, line) for i, line in enumerate(lines) if line.strip()]
    return [(i, r, line) for r, (i, line) in enumerate(kept)]


def random_text(seed, n):
    rng = random.Random(seed)
    lines = [rng.choice(["", "  ", " "]) if rng.random() < 0.2 else f'{{"i": {i}}}' for i in range(n)]
    return rng.choice(["\n", "\r\n"]).join(lines)


@pytest.mark.parametrize("block", ["700", "134217728"])
def test_line_numbers(spark, tmp_path, block):
    texts = {f"d{s}": random_text(s, 50 + 300 * s) for s in range(4)}
    for name, text in texts.items():
        write(tmp_path / name / "test.jsonl", text)
    # a source may be a folder of part files
    parts = [random_text(9, 200), random_text(10, 100)]
    parts = [p + "\n" for p in parts]
    for i, part in enumerate(parts):
        write(tmp_path / "folder" / "test.jsonl" / f"part-{i:05d}.txt", part)
    texts["folder"] = "".join(parts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = read_split(spark, str(tmp_path), sorted(texts)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.split for r in got} == {"test"}
    for name, text in texts.items():
        mine = sorted((r.line_idx, r.rec_idx, r.value) for r in got if r.dataset == name)
        assert mine == numbered(text), name


def test_line_limit_counts_blank_lines(spark, tmp_path):
    path = write(tmp_path / "d" / "test.jsonl", "\na\n\nb\nc\n")

    def values(limit):
        return sorted(r.value for r in read_jsonl(spark, path, limit).collect())

    assert values(2) == ["a"] and values(4) == ["a", "b"]
    assert values(None) == values(0) == ["a", "b", "c"]
    assert values(-1) == []


def test_changed_split_fails_loudly(spark, tmp_path):
    path = write(tmp_path / "d" / "test.jsonl", "a\nb\n")
    lines = _scan(spark, [path])
    moved = _block_table(lines).withColumn("_part", F.col("_part") + 1)
    with pytest.raises(Exception, match="split differently"):
        number_lines(lines, moved).collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_split(spark, str(tmp_path), "none")


def test_json_arrays(spark, tmp_path):
    for n in (3, 5):
        rows = [{"question": f"q{n}-{i}", "llm_output": None} for i in range(n)]
        write(tmp_path / f"f{n}.json", json.dumps(rows))
    got = read_json_array(spark, str(tmp_path)).collect()
    assert sorted((r.question, r.position) for r in got) == sorted(
        (f"q{n}-{i}", i) for n in (3, 5) for i in range(n)
    )
    assert read_json_array(spark, str(tmp_path), 2).count() == 4
    assert read_json_array(spark, str(tmp_path), -1).count() == 8
    sample = {r.question for r in sample_json_array(spark, str(tmp_path), 4, seed=1).collect()}
    again = {r.question for r in sample_json_array(spark, str(tmp_path), 4, seed=1).collect()}
    assert sample == again and len(sample) == 4
    assert sample_json_array(spark, str(tmp_path), 99, seed=1).count() == 8


def test_responses(spark, tmp_path):
    write(tmp_path / "math_responses.jsonl", '{"id":"a","answer":27.0,"tokens_used":3}\n\n{bad\n')
    write(tmp_path / "notes.txt", "x")
    rows = {r.raw: r for r in load_responses(spark, str(tmp_path)).collect()}
    good = rows['{"id":"a","answer":27.0,"tokens_used":3}']
    assert (good.dataset, good.id, good.answer, good.tokens_used, good.generation_id, good.error) == (
        "math", "a", "27.0", 3, 0, None,
    )
    assert rows["{bad"].error == "malformed JSON" and len(rows) == 2
    write(tmp_path / "more_responses.jsonl", '{"id":"b","tokens_used":3.0}\n{"answer":"x"}\n')
    more = {r.raw: r for r in load_responses(spark, str(tmp_path)).collect() if r.dataset == "more"}
    assert [(r.id, r.tokens_used, r.error) for r in more.values()] == [
        ("b", 3, None), (None, 0, "missing id"),
    ]


def test_catalogue(spark, tmp_path):
    write(tmp_path / "math" / "test.jsonl", "x" * 2048)
    write(tmp_path / "math" / "extra.jsonl" / "part-0", "y" * 100)
    write(tmp_path / "math" / "extra.jsonl" / "part-1", "y" * 28)
    write(tmp_path / "odd" / "readme.md", "r")
    write(tmp_path / "top.txt", "z")
    inv = catalogue.file_inventory(spark, str(tmp_path))
    assert sorted((r.dataset, r.file, r.bytes, r["size"]) for r in inv.collect()) == [
        ("math", "extra.jsonl", 128, "0.1 KB"),
        ("math", "test.jsonl", 2048, "2.0 KB"),
        ("odd", "readme.md", 1, "0.0 KB"),
    ]
    write(tmp_path / "math" / "train.jsonl", "")
    (tmp_path / "bare").mkdir()
    more = catalogue.file_inventory(spark, str(tmp_path))
    assert {(r.dataset, r.file, r.bytes) for r in more.collect()} >= {
        ("math", "train.jsonl", 0), ("bare", None, 0),
    }
    assert {r.dataset: r.n_files for r in catalogue.dataset_totals(more).collect()}["bare"] == 0
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    splits = {
        (r.dataset, r["split"]): (r.declared, r.found)
        for r in catalogue.split_catalogue(spark, inv).collect()
    }
    assert splits["math", "test"] == (True, True)
    assert splits["math", "train"] == (True, False)
    assert splits["math", "extra"] == (False, True)


def test_save_jsonl_keeps_nulls_and_text(spark, tmp_path):
    df = spark.createDataFrame([("é😀", None)], "a string, b int")
    save_jsonl(df, str(tmp_path / "x.jsonl"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "x.jsonl")).collect()]
    assert lines == ['{"a":"é😀","b":null}']


def test_save_by_dataset(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "dataset string, n int")
    save_by_dataset(df, str(tmp_path), "responses", "a")
    assert spark.read.json(str(tmp_path / "a_responses.jsonl")).count() == 2


def test_undeclared_fields(spark, tmp_path):
    lines = [
        '{"id":"a","metadata":{"level":[1,{"x":null}]},"score":NaN,"tokens_used":1}',
        '{"id":"b"}',
        '{"id":"c","split":"test","extra":null}',
        "{bad",
    ]
    write(tmp_path / "math_responses.jsonl", "\n".join(lines))
    rows = load_responses(spark, str(tmp_path)).selectExpr("raw", "id", "to_json(fields) AS fields").collect()
    got = {r["raw"]: r["fields"] for r in rows}
    assert json.loads(got[lines[0]]) == {"metadata": {"level": [1, {"x": None}]}, "score": "nan"}
    assert got[lines[1]] is None and got[lines[3]] is None
    assert json.loads(got[lines[2]]) == {"extra": None}

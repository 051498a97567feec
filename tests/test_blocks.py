"""Arrays and line files read in blocks, against the json module and plain reading."""

import gzip
import json
import random

import pytest

from evalspark.sources import blocks, json_array
from evalspark.sources.blocks import File, list_files
from evalspark.sources import line_blocks
from evalspark.sources.jsonl import read_jsonl
from evalspark.sources.json_array import read_json_array, record_texts, sample_json_array, structure

PIECES = ['"', "\\", '\\"', "[", "]", "{", "}", ",", "é", "\n", "x", "\\\\", "\U0001f389", " "]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choices(PIECES, k=rng.randrange(12)))
    if kind == 1:
        return rng.choice([None, True, 1.5, -3, 10**20])
    if kind in (2, 3):
        return rng.choice(["", "plain, text", "]"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"k" + rng.choice(PIECES): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def texts(spark, path, *args):
    rows = sorted((r["file"].rsplit("/", 1)[-1], r["position"], r["record"]) for r in record_texts(spark, path, *args).collect())
    return [(f, p, json.loads(t)) for f, p, t in rows]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_any_array(spark, tmp_path, monkeypatch, block, indent):
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 5)
    rng = random.Random(block)
    want = []
    for name in ("a.json", "b.json"):
        array = [value(rng) for _ in range(6)]
        (tmp_path / name).write_text(json.dumps(array, indent=indent, ensure_ascii=name == "a.json"))
        want += [(name, i, v) for i, v in enumerate(array)]
    assert texts(spark, str(tmp_path), None, block) == want


def test_every_cut_of_a_small_array(tmp_path):
    raw = json.dumps([{"a": 'q"\\'}, "\\", [], {"b": [1, {"c": ",]"}]}, 'x"'], ensure_ascii=False).encode()
    whole = structure(raw, json_array.OUTSIDE)
    for cut in range(len(raw) + 1):
        left = structure(raw[:cut], json_array.OUTSIDE)
        right = structure(raw[cut:], left[3])
        places = [*left[0].tolist(), *(right[0] + cut).tolist()]
        assert places == whole[0].tolist() and right[3] == whole[3]


def test_one_file_is_many_tasks(spark, tmp_path):
    array = [{"n": i, "text": "x" * 50} for i in range(1000)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps(array))
    size = path.stat().st_size
    rows = read_json_array(spark, str(path), schema="n int, text string", block_bytes=-(-size // 8))
    assert rows.rdd.getNumPartitions() == 8
    per_task = [len(p) for p in rows.rdd.glom().collect()]
    assert min(per_task) > 100
    assert sorted((r["n"], r["position"]) for r in rows.collect()) == [(i, i) for i in range(1000)]


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for i in range(200):
        (tmp_path / f"{i:03}.json").write_text(json.dumps([{"n": 3 * i + j} for j in range(3)]))
    scans = []
    real = blocks.on_blocks
    monkeypatch.setattr(blocks, "on_blocks", lambda spark, held, *rest: scans.append(len(held)) or real(spark, held, *rest))
    rows = read_json_array(spark, str(tmp_path), schema="n int")
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and not sum(scans)
    assert sorted((r["n"], r["position"]) for r in rows.collect()) == [(n, n % 3) for n in range(600)]


def test_a_small_block_reads_little_behind_it(tmp_path, monkeypatch):
    path = tmp_path / "long.json"
    path.write_text(json.dumps([{"n": i, "text": "z" * 40} for i in range(20_000)]))
    file = File(str(path), str(path), path.stat().st_size, 0)
    read = []
    real = blocks.chunks_of
    monkeypatch.setattr(blocks, "chunks_of", lambda *a: (read.append(len(raw)) or raw for raw in real(*a)))
    item = (blocks.Block(0, file, 0, 1000), json_array.OUTSIDE, 0, 0, None)
    rows = [n for batch in json_array._records(item, 0) for n in batch.column("position").to_pylist()]
    assert rows == list(range(len(rows))) and 10 < len(rows) < 30
    assert sum(read) <= 1000 + blocks.FIRST_BYTES


def test_a_scan_gives_a_small_row(tmp_path):
    # read as if it began inside a string, every record closes a bracket more than it opens
    path = tmp_path / "drift.json"
    path.write_text(json.dumps([{"n": i, "tag": f'["{i}", {{"a": "\\", ]"}}]'} for i in range(2000)]))
    file = File(str(path), str(path), path.stat().st_size, 0)
    cut = blocks.source_blocks(0, [file], 1 << 15)
    found = [row for i, block in enumerate(cut) for batch in json_array._scan(block, i) for row in batch.to_pylist()]
    assert len(found) > 3 and min(min(row["changes"]) for row in found) < -300
    assert max(len(json.dumps(row)) for row in found) < 300
    chain, commas = json_array._chained(found)
    assert commas == 1999 and all(depth in (0, 1, 2) for _, depth, _ in chain)


@pytest.mark.parametrize("text", ["[1,2]],[3,4],5],6,[7,8", "[1]]]],2,[[[[3,4],5],6]", "[[1,2],3][4,[5,6]],7]", '["]",1]],"[",2[[3,4', "[1]" + "]" * 40 + "," * 9 + "[" * 41 + "5,6]"])
def test_stray_brackets_are_counted_at_any_cut(spark, tmp_path, monkeypatch, text):
    path = tmp_path / "stray.json"
    path.write_text(text)
    (file,) = list_files(spark, str(path))
    anew = []
    real = blocks.on_blocks
    monkeypatch.setattr(json_array, "on_blocks", lambda spark, held, work, schema: anew.append(work) or real(spark, held, work, schema))
    for size in (4, 9):
        state, depth, commas, begun = json_array.OUTSIDE, 0, 0, []
        found = json_array.scanned(spark, [[file]], json_array._scan, json_array.SCAN_SCHEMA, None, size)
        json_array._count_rest(spark, found)
        for block, _ in found[0]:
            begun.append((state, depth, commas))
            _, bytes_, depths, state = structure(text.encode()[block.start : block.end], state)
            commas += int(((bytes_ == ord(",")) & (depths + depth == 1)).sum())
            depth += int(depths[-1]) if len(depths) else 0
        assert json_array._chained([row for _, row in found[0]]) == (begun, commas)
    assert json_array._counted in anew


def test_odd_files(spark, tmp_path):
    for name, text in {
        "empty.json": "", "blank.json": " \n", "none.json": " [ ] ", "object.json": ' {"a": [1, 2]} ', "bom.json": "﻿[1]",
        "cut.json": '[{"a": 1}, {"a": 2', "nested.json": "[[], [[1, 2], [3]], {}]", "_hidden.json": "[9]",
    }.items():
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "zip.json.gz", "wt") as file:
        file.write(json.dumps([{"a": i, "b": ","} for i in range(50)]))
    got = sorted((r["file"].rsplit("/", 1)[-1], r["position"], r["record"]) for r in record_texts(spark, str(tmp_path), None, 3).collect())
    zipped = [(f, p, json.loads(r)) for f, p, r in got if f == "zip.json.gz"]
    assert sorted(zipped, key=lambda z: z[1]) == [("zip.json.gz", i, {"a": i, "b": ","}) for i in range(50)]
    assert [g for g in got if g[0] != "zip.json.gz"] == [
        ("bom.json", 0, "1"), ("cut.json", 0, '{"a": 1}'), ("cut.json", 1, '{"a": 2'),
        ("nested.json", 0, "[]"), ("nested.json", 1, "[[1, 2], [3]]"), ("nested.json", 2, "{}"), ("object.json", 0, '{"a": [1, 2]}'),
    ]


def test_a_limit_reads_a_prefix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST_BYTES", 256)
    array = [{"n": i, "text": "y" * 40} for i in range(20_000)]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(array))
    sizes = []
    real = json_array.scanned

    def counted(*args):
        found = real(*args)
        sizes.append(sum(block.end - block.start for source in found for block, _ in source))
        return found

    monkeypatch.setattr(json_array, "scanned", counted)
    for n in (0, 1, 5, 300):
        got = sorted(r["n"] for r in read_json_array(spark, str(path), n, "n int").collect())
        assert got == list(range(n))
    assert sizes[:2] == [256, 512] and max(sizes) < 0.05 * path.stat().st_size
    assert read_json_array(spark, str(path), 30_000, "n int").count() == 20_000


def test_schema_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": [1.5]}, "d": null, "e": 1}, {"a": 2, "e": "x", "f": NaN}, {"g": true}]')
    rows = read_json_array(spark, str(tmp_path))
    kinds = dict(rows.dtypes)
    assert kinds["a"] == "bigint" and kinds["b"] == "struct<c:array<double>>" and kinds["e"] == kinds["d"] == "string"
    assert [r["f"] for r in rows.where("a = 2").collect()] == ["nan"]
    assert sorted((r["a"], r["e"]) for r in rows.where("a is not null").collect()) == [(1, "1"), (2, "x")]
    missing = str(tmp_path / "none" / "x.json")
    empty = read_json_array(spark, missing, schema="a int")
    assert empty.columns == ["a", "file", "position"] and empty.count() == 0
    assert read_json_array(spark, missing).count() == 0
    with pytest.raises(FileNotFoundError):
        read_json_array(spark, missing, missing_ok=False)


def test_samples_know_folders_apart(spark, tmp_path):
    for folder in ("r/one", "r/two", "copy/r/one", "copy/r/two"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.json").write_text(json.dumps([{"id": f"{folder[-3:]}{i}"} for i in range(40)]))
    drawn = {r["id"] for r in sample_json_array(spark, str(tmp_path / "r"), 20, seed=1).collect()}
    assert drawn == {r["id"] for r in sample_json_array(spark, str(tmp_path / "copy/r"), 20, seed=1).collect()}
    assert {x[3:] for x in drawn if x.startswith("one")} != {x[3:] for x in drawn if x.startswith("two")}
    assert len(sample_json_array(spark, str(tmp_path / "r"), 7, seed=1, keys=["id"]).collect()) == 7


def test_list_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x%.txt").write_text("hi")
    (file,) = list_files(spark, str(tmp_path))
    assert isinstance(file, File) and file.length == 2 and b"".join(blocks.chunks_of(file, 0)) == b"hi"
    assert file.name == spark.read.text(str(tmp_path / "a b")).selectExpr("_metadata.file_path").first()[0]


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 20])
def test_lines_of_any_file(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 4)
    rng = random.Random(block)
    for n in range(30):
        raw = "".join(rng.choices(["a", "é", " ", "\n", "\r", "\r\n", "\u3000", "\x85"], k=rng.randrange(25))).encode()
        path = tmp_path / f"{n}.jsonl"
        path.write_bytes(raw)
        (file,) = list_files(spark, str(path))
        cut = blocks.source_blocks(0, [file], block)
        got = [line for b in cut for line in line_blocks.lines_of(b)]
        assert got == raw.splitlines()


def test_limited_reading_equals_whole_reading(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST_BYTES", 40)
    rng = random.Random(6)
    for name in ("one", "two"):
        folder = tmp_path / name / "test.jsonl"
        folder.mkdir(parents=True)
        for part in range(4):
            lines = [rng.choice(["", " ", f"line {rng.random()}", "\u3000"]) for _ in range(rng.randrange(30))]
            (folder / f"part-{part}").write_text("\n".join(lines) + rng.choice(["", "\n"]))
    paths = [str(tmp_path / n / "test.jsonl") for n in ("one", "two")]

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    whole = read_jsonl(spark, paths)
    for limit in (1, 7, 50, 10_000):
        assert rows(read_jsonl(spark, paths, limit)) == rows(whole.where(f"line_idx < {limit}"))


def test_a_line_limit_reads_less_than_a_hundredth(spark, tmp_path, monkeypatch):
    path = tmp_path / "d" / "test.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(json.dumps({"n": i, "text": "z" * 100}) for i in range(100_000)))
    read = []
    real = line_blocks.scanned

    def counted(*args):
        found = real(*args)
        read.append(sum(block.end - block.start for source in found for block, _ in source))
        return found

    monkeypatch.setattr(line_blocks, "scanned", counted)
    assert read_jsonl(spark, str(path), 5).count() == 5
    assert read[0] < 0.01 * path.stat().st_size


def test_kept_index_saves_a_scan(spark, tmp_path):
    path = tmp_path / "d" / "test.jsonl"
    path.parent.mkdir()
    path.write_text("a\n\nb\n" * 50)
    index = str(tmp_path / "index")

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan text")

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    first = read_jsonl(spark, str(path), index_dir=index)
    want = rows(read_jsonl(spark, str(path)))
    # the kept counts replace the first of two scans
    assert scans(read_jsonl(spark, str(path))) == 2 and scans(first) == 1
    assert rows(first) == want
    assert rows(read_jsonl(spark, str(path), index_dir=index)) == want
    assert len(list((tmp_path / "index").iterdir())) == 1
    # a changed file is counted anew
    path.write_text("x\n" * 7)
    assert len(rows(read_jsonl(spark, str(path), index_dir=index))) == 7
    assert len(list((tmp_path / "index").iterdir())) == 2

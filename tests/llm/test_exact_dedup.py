import hashlib
import re

from pyspark.sql import functions as F

from evalspark.llm import exact_dedup
from llm.samples import documents, edge_rows


def brute(rows):
    body = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in rows]
    groups = {}
    for i, b in body:
        groups.setdefault(b, []).append(i)
    out = []
    for i, b in body:
        ids = [x for x in groups[b] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[b]), i == keep, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edges(spark):
    rows = edge_rows()
    for capacity in (1, 4, 1 << 13):
        assert found(exact_dedup.group_copies(documents(spark, rows, clashing=True), capacity)) == brute(rows)


def test_one_hot_group(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}", None, None, None) for i in range(3_000)]
    assert found(exact_dedup.group_copies(documents(spark, rows), 64)) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup.group_copies(documents(spark, [])).count() == 0


def test_directory(spark):
    entries = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    buckets = exact_dedup.directory(entries, 100)
    rows = buckets.collect()
    assert sum(r["entries"] for r in rows) == 5_000
    assert max(r["entries"] for r in rows) <= 100
    depth = max(r["depth"] for r in rows)
    slots = [r["slot"] for r in exact_dedup.pointers(buckets, depth).collect()]
    # a bucket without entries isn't stored, so its slots have no pointer
    assert len(slots) == len(set(slots)) <= 1 << depth


def test_chained_collisions(spark, monkeypatch):
    # all hashes equal: one bucket holds all entries, told apart by their bytes
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(5).cast("bigint"))
    rows = edge_rows()
    assert found(exact_dedup.group_copies(documents(spark, rows), 2)) == brute(rows)


def test_bytes_are_compared_in_the_buckets(spark, monkeypatch):
    # without places in the chain, texts of equal hash would become one group
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(5).cast("bigint"))
    monkeypatch.setattr(exact_dedup.F, "dense_rank", lambda: F.max(F.lit(1)))
    rows = [(1, "a", None, None, None), (2, "b", None, None, None)]
    merged = exact_dedup.group_copies(documents(spark, rows)).collect()
    assert {r["group_size"] for r in merged} != {1}


def test_groups_over_many_partitions(spark):
    rows = [(i, f"text {i % 7}", None, None, None) for i in range(400)]
    docs = documents(spark, rows).repartition(23)
    assert found(exact_dedup.group_copies(docs, 2)) == brute(rows)


def test_plan_is_native(spark):
    plan = exact_dedup.group_copies(documents(spark, edge_rows()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))

import random

from pyspark.sql import functions as F

from evalspark.llm import mixing
from llm.samples import CLASHES, documents, edge_rows, sentence


def filled(sizes, weights, share, cap):
    """Targets by rounds: give by weight, stop at the cap, share the excess again."""
    sources = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target = dict.fromkeys(sources, 0.0)
    rest, free = share * sum(sizes.values()), set(sources)
    while free and rest > 1e-6:
        total = sum(weight[s] for s in free)
        given = {s: rest * weight[s] / total for s in free}
        rest = 0.0
        for s in list(free):
            target[s] += given[s]
            if target[s] > cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_targets_and_taken(spark):
    rng = random.Random(1)
    sources = [f"s{i:02d}" for i in range(11)] + [None]
    rows = [
        (i, sentence(rng, rng.choice((1, 5, 20, 60))), None, "s00" if i % 3 == 0 else rng.choice(sources), None)
        for i in range(3_000)
    ]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = filled(sizes, (5, 2, 1), 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    # within a document of the target
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    again = mixing.mix_sources(documents(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_larger_documents_are_likelier(spark):
    rows = [(i, "w " * (5 if i % 2 else 320), None, f"s{i % 4 // 2}", None) for i in range(4_000)]
    mixed = mixing.mix_sources(documents(spark, rows), weights=(5, 1), tilt=0.5)
    by = {
        (r["source"], r["size"]): r["c"]
        for r in mixed.groupBy("source", "size").agg(F.avg("copies").alias("c")).collect()
    }
    assert by["s1", 320] > 1.5 * by["s1", 5]


def test_edges(spark):
    rows = edge_rows()
    mixed = mixing.mix_sources(documents(spark, rows, clashing=True))
    got = mixed.collect()
    assert len(got) == len(rows)
    assert {r["size"] for r in got if not (r["text"] or "").strip()} == {0}
    assert set(CLASHES) <= set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    assert mixing.repeated(mixed).count() == sum(r["copies"] for r in got)
    only_blank = [(i, "  ", None, "a", None) for i in range(3)]
    assert [r["taken"] for r in mixing.mix_sources(documents(spark, only_blank)).collect()] == [0, 0, 0]


def test_empty_table(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = mixing.mix_sources(documents(spark, edge_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

import random

import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm import near_dedup
from evalspark.llm.components import components
from llm.samples import documents, edge_rows


def word_sets(rows, words):
    out = []
    for _, text in rows:
        w = [x for x in (text or "").encode().lower().split()]
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def grouped(count, links):
    parent = list(range(count))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(x) for x in range(count)]


def brute(rows, words, numerator, denominator):
    sets = word_sets(rows, words)
    links = []
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and denominator * shared >= numerator * len(sets[a] | sets[b]):
                links.append((a, b))
    roots = grouped(len(sets), links)
    out = []
    for row, (doc_id, _) in enumerate(rows):
        ids = [rows[o][0] for o in range(len(rows)) if roots[o] == roots[row] and rows[o][0] is not None]
        least = min(ids) if ids and sets[row] else doc_id
        out.append((doc_id, len(sets[row]), least, doc_id == least))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def near_copies(seed, bases, copies, length=60):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((" ".join(text)))
    rng.shuffle(rows)
    return [(7 * i, t, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,numerator", [(3, 85), (5, 80)])
def test_edges(spark, words, numerator):
    rows = edge_rows()
    got = near_dedup.near_duplicates(documents(spark, rows, clashing=True), words, numerator, 100)
    assert found(got) == brute([r[:2] for r in rows], words, numerator, 100)


def test_near_copies(spark):
    rows = near_copies(1, 40, 8)
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85, 100)
    assert found(got) == brute([r[:2] for r in rows], 3, 85, 100)


def test_large_cluster_leaf_by_leaf(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 40)
    monkeypatch.setattr(near_dedup, "CLUSTER_CLASSES", 50)
    rows = near_copies(2, 2, 250)
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85, 100)
    assert found(got) == brute([r[:2] for r in rows], 3, 85, 100)


def test_rows_that_no_order_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "MAX_ROUNDS", 2)
    base = " ".join(f"w{i}" for i in range(2_000))
    rows = [(i, f"{base} tail{i}", None, None, None) for i in range(60)]
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85, 100)
    assert {r[2] for r in found(got)} == {0}


def test_recall_of_distinct_sets_in_one_node(spark, monkeypatch):
    # all texts share half their words, so nodes below the root are large; each is at the threshold with one other
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for p in range(150):
        own = [f"p{p}w{i}" for i in range(80)]
        other = list(own)
        # 198 shingles each, 182 shared of 214: 0.8505
        other[-16:] = [f"q{p}w{i}" for i in range(16)]
        rows += [(10 * p, " ".join(common + own), None, None, None), (10 * p + 1, " ".join(common + other), None, None, None)]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85, 100, trees=6)
    assert found(got) == brute([r[:2] for r in rows], 3, 85, 100)


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_by_depth(similarity):
    rng = np.random.default_rng(11)
    pairs = 400
    first = rng.integers(0, 1 << 16, (pairs, near_dedup.TOKENS), dtype=np.uint16)
    second = np.where(rng.random(first.shape) < similarity, first, first ^ np.uint16(1))
    tokens = [row.tobytes() for both in zip(first, second) for row in both]
    item = np.arange(2 * pairs)
    node = np.full(2 * pairs, 12345, dtype=np.int64)
    for depth, jump in enumerate([near_dedup.ROOT_JUMP, 4, 4, 4]):
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(node + item // 2),
                pa.array([int(i).to_bytes(8, "little") for i in item]),
                pa.array(item),
                pa.array([tokens[i] for i in item], pa.binary()),
                pa.array(np.full(len(item), jump, dtype=np.int32)),
            ],
            names=["node", "class", "color", "tokens", "jump"],
        )
        out = pa.Table.from_batches(list(near_dedup._branched(similarity, depth == 0)(iter([batch]))))
        kids, who = out.column("node").to_numpy(), out.column("color").to_numpy()
        places = {}
        for kid, i in zip(kids.tolist(), who.tolist()):
            places.setdefault((kid, i // 2), set()).add(i)
        together = [(kid, p) for (kid, p), both in places.items() if len(both) == 2]
        # a tree keeps 0.76 of the pairs at the root, and few are lost below it
        assert len({p for _, p in together}) / pairs > 0.69
        # the deeper nodes of a pair, a few of them for speed
        few = {}
        for kid, p in together:
            few.setdefault(p, []).append(kid)
        chosen = [(kid, p) for p, all_ in few.items() for kid in all_[:20]]
        node = np.array([kid - p for kid, p in chosen for _ in (0, 1)], dtype=np.int64)
        item = np.array([2 * p + k for _, p in chosen for k in (0, 1)])


def test_members_with_a_single_link_in_a_node_that_stays_large(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "MAX_ROUNDS", 1)
    # every text is similar to the hub alone, or to the member that it follows
    base = " ".join(f"w{i}" for i in range(200))
    tail = [" ".join(f"t{m}x{i}" for i in range(30)) for m in range(40)]
    rows = [(m + 1, f"{base} {t}", None, None, None) for m, t in enumerate(tail)] + [(0, base, None, None, None)]
    rows += [(100 + m, f"{base} {t} " + " ".join(f"u{m}x{i}" for i in range(30)), None, None, None) for m, t in enumerate(tail[:10])]
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85, 100)
    assert found(got) == brute([r[:2] for r in rows], 3, 85, 100)
    assert {r[2] for r in found(got)} == {0}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_connecting_links():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 400, 60)
        sets = [np.unique(rng.choice(base, 50)).astype(np.uint64) for _ in range(25)]
        every = [
            (a, b)
            for a in range(25)
            for b in range(a)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 45 * len(np.union1d(sets[a], sets[b]))
        ]
        links = near_dedup.connecting_links(sets, 45, 100)
        assert len(links) < 25
        a, b = grouped(25, every), grouped(25, links)
        assert len({*zip(a, b)}) == len(set(a)) == len(set(b))


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = grouped(1201, links)
    least = {}
    for node in got:
        least[roots[node]] = min(least.get(roots[node], node), node)
    assert got == {node: least[roots[node]] for node in got}
    assert set(got) == {x for link in links for x in link}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_leaf_links_colors_once():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 16, near_dedup.TOKENS).astype(np.uint16)
    rows = np.stack([base] * 60 + [rng.integers(0, 1 << 16, near_dedup.TOKENS).astype(np.uint16) for _ in range(20)])
    color = [0] * 30 + [1] * 20 + list(range(2, 12)) + list(range(100, 120))
    order = rng.permutation(80)
    batch = pa.RecordBatch.from_pydict(
        {
            "node": [5] * 80,
            "class": [bytes([i]) for i in order.tolist()],
            "color": [color[i] for i in order.tolist()],
            "n_shingles": [50] * 80,
            "tokens": [rows[i].tobytes() for i in order.tolist()],
        }
    )
    (links,) = near_dedup._leaf_pairs(85, 100)(iter([batch]))
    # twelve colors of one family, the others alike to nothing
    assert links.num_rows == 11
    joined = {color[b[0]]: color[b[0]] for b in batch.column("class").to_pylist()}

    def root(c):
        return c if joined[c] == c else root(joined[c])

    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
        joined[root(color[a[0]])] = root(color[b[0]])
    assert len({root(c) for c in range(12)}) == 1 and all(root(c) == c for c in range(100, 120))

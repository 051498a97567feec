"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Documents of equal sets form a class, which takes
part once. Every class has a row of minwise tokens: for each of ``TOKENS`` random orders, the
first shingle of the set. Trees branch the classes: a node chooses a few of the orders by its own
hash, one for each branch, and its classes go on to the child of their token. Similar sets share most tokens, so
they meet in a child of the root with a known probability; below it so many branches are made that those together
stay so at any depth. Independent trees repeat this until the
recall is as good as one. Nodes of up to ``LEAF`` classes are leaves, in which all pairs of token rows are compared.
Classes of a larger node are first compared in full with a few of them: pairs that these connect need no leaf.
What few such classes can't connect, and what ``MAX_ROUNDS`` don't part, is compared block against block.

Pairs that the tokens leave open form candidate clusters; full sets are compared within them. A cluster
beyond ``CLUSTER_SHINGLES`` isn't gathered in one task: it is compared leaf by leaf. Within a
group, documents that are already connected aren't compared again, and a task returns only the
links that connect something, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import mix64, saved, slices, utf8
from evalspark.llm.components import components
from evalspark.session import scratch_path

TOKENS = 128
TREES = 12
LEAF = 4096
# orders that the branches of a root fix at once, so that only alike documents stay together
ROOT_JUMP = 3
# how far below the asked similarity the estimate from the tokens may lie, in standard deviations
DEVIATIONS = 5.0
# most orders that a branch may fix at once, in a node far larger than a leaf
MAX_JUMP = 12
# rounds of branching; what is together after so many is compared block against block
MAX_ROUNDS = 8
# below the root, so many of a node's branches keep a pair together on average, even if its tokens
# agree less than its sets do, by so many standard deviations
GROWTH = 3.0
LOW_TOKENS = 2.0
# classes with which all others of a node larger than a leaf are compared in full
REPRESENTATIVES = 2
# rows that a branching task makes at once
BRANCH_ROWS = 1 << 18
# pairs that a leaf holds before it joins them
LEAF_PAIRS = 1 << 16
CLUSTER_SHINGLES = 4 << 20
CLUSTER_CLASSES = 4096
LEAST_ID = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, separated by ASCII blanks."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), dtype=np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words than a shingle are one shingle."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * _ODD + hashes[k : k + count])
    return np.unique(out)


def _orders() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * _ODD)
    return seeds[:TOKENS] | np.uint64(1), seeds[TOKENS:]


def token_rows(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens, 16 bits each, of sets that aren't empty."""
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), TOKENS), dtype=np.uint16)
    for i, (factor, offset) in enumerate(zip(*_orders())):
        values = every * factor
        values += offset
        values ^= values >> np.uint64(32)
        values *= _ODD
        least = np.minimum.reduceat(values, starts)
        out[:, i] = (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _describe(words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, words) for t in utf8(part, "text")]
                full = [s for s in sets if len(s)]
                rows = iter(token_rows(full)) if full else iter(())
                tokens = [next(rows).tobytes() if len(s) else None for s in sets]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(tokens, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "class", "tokens"],
                )

    return describe


def _token_matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint16).reshape(-1, TOKENS)


def _branches(similarity: float, orders: np.ndarray, node: np.ndarray, root: bool) -> np.ndarray:
    """How many branches a node has when each fixes so many orders.

    Of a root's, one keeps a pair at the threshold together on average. A pair in a deeper node has to stay
    together again and again, so ``GROWTH`` branches do.
    """
    if root:
        wanted = similarity ** -orders.astype(float)
    else:
        spread = math.sqrt(similarity * (1 - similarity) / TOKENS)
        wanted = GROWTH * max(similarity - LOW_TOKENS * spread, similarity / 2) ** -orders.astype(float)
    chance = mix64(node ^ _ODD) / float(1 << 64)
    return np.floor(wanted).astype(np.int64) + (chance < wanted - np.floor(wanted))


def _branched(similarity: float, root: bool):
    """Children of (node, class, color, tokens, jump) rows; a jump is the number of orders a branch fixes."""

    def children(batch: pa.RecordBatch, branches: np.ndarray) -> pa.RecordBatch:
        tokens = _token_matrix(batch.column("tokens"))
        node = np.asarray(batch.column("node")).astype(np.int64).view(np.uint64)
        jump = np.asarray(batch.column("jump")).astype(np.int64)
        rows = np.repeat(np.arange(len(node)), branches)
        number = np.arange(len(rows)) - np.repeat(np.cumsum(branches) - branches, branches)
        child = mix64(node[rows] + (number.astype(np.uint64) + np.uint64(1)) * _ODD)
        path = child.copy()
        for step in range(int(jump.max())):
            on = jump[rows] > step
            order = (mix64(child + np.uint64(step + 1)) % np.uint64(TOKENS)).astype(np.int64)
            value = order.astype(np.uint64) << np.uint64(16) | tokens[rows, order].astype(np.uint64)
            path[on] = mix64(path[on] ^ mix64(value[on] + _ODD))
        taken = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(path.view(np.int64)), batch.column("class").take(taken), batch.column("color").take(taken)],
            names=["node", "class", "color"],
        )

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.asarray(batch.column("node")).astype(np.int64).view(np.uint64)
            branches = _branches(similarity, np.asarray(batch.column("jump")).astype(np.int64), node, root)
            step = max(1, BRANCH_ROWS // int(branches.max()))
            for start in range(0, batch.num_rows, step):
                yield children(batch.slice(start, step), branches[start : start + step])

    return branch


def _planted(trees: int):
    """The root rows of every class, one for each tree."""
    roots = F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(trees)])
    return F.explode(roots)


def _runs(
    batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with whole groups of equal ``key`` from a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1].as_py()
        first_of_last = keys.to_pylist().index(last)
        if held and held[-1].column(key)[-1].as_py() == last and first_of_last == 0:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, first_of_last)]).combine_chunks()
        for part in whole.to_batches():
            if part.num_rows and (out := work(part)) is not None:
                yield out
        held = [batch.slice(first_of_last)]
    if held:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            if (out := work(part)) is not None:
                yield out


def _joined_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each item's connected group, from pairs of items."""
    labels = np.arange(count)
    while True:
        before = labels.copy()
        np.minimum.at(labels, left, labels[right])
        np.minimum.at(labels, right, labels[left])
        labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def _links(keys: pa.Array, members: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(members)), keys.take(pa.array(others))], names=["a", "b"]
    )


def _least_tokens(similarity: float) -> int:
    """Of how many equal tokens the similarity is still possible."""
    return math.floor(
        TOKENS * similarity - DEVIATIONS * math.sqrt(TOKENS * similarity * (1 - similarity))
    )


def _leaf_pairs(numerator: int, denominator: int):
    """Connects the classes of a leaf whose token rows leave the similarity possible.

    Classes of one color in a node are connected already: of the pairs between two colors as many become links
    as connect them, fewer than there are colors.
    """
    least = _least_tokens(numerator / denominator)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            node = np.asarray(part.column("node"))
            size = np.asarray(part.column("n_shingles"))
            tokens = _token_matrix(part.column("tokens"))
            places = np.stack([node, np.asarray(part.column("color"))], axis=1)
            _, first, color = np.unique(places, axis=0, return_index=True, return_inverse=True)
            color = color.reshape(-1)
            label = np.arange(len(first))
            left, right, held = [label], [label], 0

            def joined() -> np.ndarray:
                return _joined_labels(len(first), np.concatenate([*left, label]), np.concatenate([*right, label]))

            rows = np.arange(len(node))
            for step in range(1, len(node)):
                rows = rows[rows < len(node) - step]
                rows = rows[node[rows] == node[rows + step]]
                if not len(rows):
                    break
                small = np.minimum(size[rows], size[rows + step])
                large = np.maximum(size[rows], size[rows + step])
                # what is connected so far isn't compared
                apart = label[color[rows]] != label[color[rows + step]]
                can = rows[(small * denominator >= large * numerator) & apart]
                same = (tokens[can] == tokens[can + step]).sum(axis=1)
                found = can[same >= least]
                left.append(color[found])
                right.append(color[found + step])
                held += len(found)
                if held > LEAF_PAIRS:
                    label = joined()
                    left, right, held = [np.arange(len(first))], [label], 0
            label = joined()
            moved = np.flatnonzero(label != np.arange(len(first)))
            return _links(part.column("class"), first[moved], first[label[moved]])

        yield from _runs(batches, "node", work)

    return compare


def connecting_links(sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links of similar sets that connect all that are connected.

    Every pair whose ends aren't connected already is compared: all sets outside the largest
    component so far are compared with all others, so the pairs left out lie within it.
    """
    count = len(sets)
    lengths = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    owners = np.repeat(np.arange(count), lengths)
    order = np.argsort(items, kind="stable")
    held = owners[order]
    values = items[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    starts = np.flatnonzero(first)
    widths = np.diff(np.append(starts, len(values)))
    place = np.empty(len(items), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    ends = np.cumsum(lengths)
    labels = np.arange(count)
    compared = np.zeros(count, dtype=bool)
    links = []
    while True:
        largest = np.bincount(labels, minlength=count).argmax()
        todo = np.flatnonzero(~compared & (labels != largest))
        if not len(todo):
            return links
        for pivot in todo.tolist():
            if compared[pivot] or labels[pivot] == largest:
                continue
            compared[pivot] = True
            mine = place[ends[pivot] - lengths[pivot] : ends[pivot]]
            mine = mine[widths[mine] > 1]
            total = widths[mine]
            at = np.repeat(starts[mine] - np.cumsum(total) + total, total) + np.arange(total.sum())
            shared = np.bincount(held[at], minlength=count)
            union = lengths + lengths[pivot] - shared
            near = (shared * denominator >= union * numerator) & (labels != labels[pivot])
            for other in np.flatnonzero(near).tolist():
                if labels[other] != labels[pivot]:
                    links.append((pivot, other))
                    labels[labels == labels[other]] = labels[pivot]
            if labels[pivot] != largest and near.any():
                largest = np.bincount(labels, minlength=count).argmax()


def _confirmed(words: int, numerator: int, denominator: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            groups = np.asarray(part.column("group"))
            texts = utf8(part, "text")
            names = part.column("class").to_pylist()
            left, right = [], []
            bounds = np.flatnonzero(np.diff(groups)) + 1
            for rows in np.split(np.arange(len(groups)), bounds):
                found: dict[bytes, int] = {}
                sets = []
                for row in rows.tolist():
                    # a copy, or another text under the same doc_id, isn't the class's text
                    if names[row] not in found:
                        items = shingle_set(texts[row], words)
                        if xxhash.xxh3_128_digest(items.tobytes()) == names[row]:
                            found[names[row]] = row
                            sets.append(items)
                kept = list(found.values())
                if len(kept) > 1:
                    for a, b in connecting_links(sets, numerator, denominator):
                        left.append(kept[a])
                        right.append(kept[b])
            return _links(part.column("class"), np.array(left, int), np.array(right, int))

        yield from _runs(batches, "group", work)

    return confirm


def _possible(numerator: int, denominator: int):
    """The (class, rep) rows whose sizes and token rows leave the similarity possible."""
    least = _least_tokens(numerator / denominator)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = np.asarray(batch.column("n_shingles")), np.asarray(batch.column("rep_shingles"))
            can = np.minimum(own, other) * denominator >= np.maximum(own, other) * numerator
            tokens, others = _token_matrix(batch.column("tokens")), _token_matrix(batch.column("rep_tokens"))
            can &= (tokens == others).sum(axis=1) >= least
            yield batch.filter(pa.array(can)).select(["class", "rep", "size"])

    return possible


def _starred(words: int, numerator: int, denominator: int):
    """Links the classes of a group with its representative, ``rep``, whose row is among them."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            groups = np.asarray(part.column("group"))
            names, reps = part.column("class").to_pylist(), part.column("rep").to_pylist()
            texts = utf8(part, "text")
            linked = []
            for rows in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(groups)) + 1):
                hubs: dict[bytes, np.ndarray] = {}
                others = []
                for row in rows.tolist():
                    items = shingle_set(texts[row], words)
                    # a copy, or another text under the same doc_id, isn't the class's text
                    if xxhash.xxh3_128_digest(items.tobytes()) != names[row]:
                        continue
                    if names[row] == reps[row]:
                        hubs[names[row]] = items
                    else:
                        others.append((row, items))
                for row, items in others:
                    hub = hubs[reps[row]]
                    shared = len(np.intersect1d(items, hub, assume_unique=True))
                    if shared * denominator >= (len(items) + len(hub) - shared) * numerator:
                        linked.append(row)
            at = pa.array(np.array(linked, int))
            return pa.RecordBatch.from_arrays(
                [part.column("class").take(at), part.column("rep").take(at)], names=["a", "b"]
            )

        yield from _runs(batches, "group", work)

    return star


def _colored(
    hot: DataFrame, classes: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int
) -> tuple[DataFrame, DataFrame]:
    """The classes of hot nodes with the color of a representative that they are similar to, and these links.

    Classes of one color in a node are connected. The representatives of all nodes come from the same
    orders, so that nodes with the same classes compare the same pairs. Classes are dealt out in parts; each
    part has the text of its representative.
    """
    spark = hot.sparkSession
    chosen = F.struct("class", "color", "tokens", "n_shingles")
    reps = hot.groupBy("node").agg(
        F.array_distinct(
            F.array(*[F.min_by(chosen, F.xxhash64("class", F.lit(i))) for i in range(REPRESENTATIVES)])
        ).alias("reps")
    )
    # a representative takes the color of an earlier one only, so that the first keeps its own
    pairs = (
        hot.join(reps, "node")
        .withColumn("own", F.array_position(F.transform("reps", lambda r: r["class"]), F.col("class")))
        .select("*", F.posexplode("reps").alias("pos", "r"))
        .where("color <> r.color and (own = 0 or pos < own - 1)")
    )
    possible = pairs.select(
        "class", "tokens", "n_shingles", "size", F.col("r.class").alias("rep"),
        F.col("r.tokens").alias("rep_tokens"), F.col("r.n_shingles").alias("rep_shingles"),
    ).mapInArrow(_possible(numerator, denominator), "class binary, rep binary, size long")
    members = saved(
        possible.groupBy("class", "rep")
        .agg(F.max("size").alias("size"))
        .select("class", "rep", F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / LEAF)).alias("part")),
        scratch_path(spark, "path-members"),
    )
    hubs = members.select(F.col("rep").alias("class"), "rep", "part").distinct()
    stars = saved(
        members.unionByName(hubs)
        .join(classes.select("class", F.col("where.k").alias("k"), F.col("where.text_hash").alias("text_hash")), "class")
        .join(texts, ["k", "text_hash"])
        .select(F.xxhash64("rep", "part").alias("group"), "class", "rep", "text")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(_starred(words, numerator, denominator), "a binary, b binary")
        .distinct(),
        scratch_path(spark, "path-stars"),
    )
    near = (
        pairs.select("node", "class", "pos", F.col("r.class").alias("rep"), F.col("r.color").alias("to"))
        .join(stars.select(F.col("a").alias("class"), F.col("b").alias("rep")), ["class", "rep"])
        .groupBy("node", "class")
        .agg(F.min_by("to", "pos").alias("to"))
    )
    colored = hot.join(near, ["node", "class"], "left").withColumn("color", F.coalesce("to", "color")).drop("to")
    return saved(colored, scratch_path(spark, "path-colors")), stars


def _blocks(nodes: DataFrame) -> DataFrame:
    """``node``, ``class``, ``color`` of leaves in which all pairs of a node meet, but those of its main color.

    The classes of the main color and the others are cut into blocks of half a leaf; every block of
    others meets every block.
    """
    half = max(1, LEAF // 2)
    other = F.col("color") != F.col("main")
    at = F.xxhash64("class", "node")
    cut = nodes.select(
        "node", "class", "color", other.alias("other"), at.alias("at"),
        F.ceil(F.col("others") / half).alias("a"), F.ceil((F.col("size") - F.col("others")) / half).alias("b"),
    )
    met = cut.select(
        "node", "class", "color",
        F.when(F.col("other"), F.pmod("at", "a")).otherwise(F.col("a") + F.pmod("at", "b")).alias("i"),
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.when(F.col("other"), F.col("a") + F.col("b")).otherwise(F.col("a")) - 1)
        ).alias("j"),
    )
    return met.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "class", "color")


def _leaves(
    classes: DataFrame, texts: DataFrame, trees: int, words: int, numerator: int, denominator: int
) -> tuple[DataFrame, DataFrame]:
    """``node``, ``class``, ``color`` of all leaves with more than one class, and links ``a``, ``b`` found on the way.

    Pairs that no leaf holds, though they stayed together, are connected by the links.
    """
    spark = classes.sparkSession
    similarity = numerator / denominator
    level = classes.select(
        _planted(trees).alias("node"), "class", F.xxhash64("class").alias("color"), "tokens", F.lit(ROOT_JUMP).alias("jump")
    )
    leaves: list[DataFrame] = []
    links = spark.createDataFrame([], "a binary, b binary")
    for depth in range(MAX_ROUNDS):
        rows = saved(
            level.mapInArrow(_branched(similarity, depth == 0), "node long, class binary, color long"),
            scratch_path(spark, "path-rows"),
        )
        # classes of one color are connected already
        sizes = (
            rows.groupBy("node")
            .agg(F.count(F.lit(1)).alias("size"), F.min("color").alias("low"), F.max("color").alias("high"))
            .where("size > 1 and low <> high")
            .select("node", "size")
        )
        sized = saved(rows.join(sizes, "node"), scratch_path(spark, "path-nodes"))
        leaves.append(sized.where(F.col("size") <= LEAF).select("node", "class", "color"))
        large = sized.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        hot = saved(
            large.join(classes.select("class", "tokens", "n_shingles"), "class"), scratch_path(spark, "path-hot")
        )
        colored, stars = _colored(hot, classes, texts, words, numerator, denominator)
        links = links.unionByName(stars)
        colors = colored.groupBy("node", "color").agg(F.count(F.lit(1)).alias("n"))
        main = colors.groupBy("node").agg(
            F.max_by("color", F.struct("n", "color")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
        )
        nodes = saved(colored.join(main.where("others > 0"), "node"), scratch_path(spark, "path-large"))
        # few others are compared with all at once
        done = F.lit(True) if depth == MAX_ROUNDS - 1 else F.col("others") * 2 <= LEAF
        leaves.append(_blocks(nodes.where(done)))
        large = nodes.where(~done)
        if large.isEmpty():
            break
        steps = F.ceil(F.log(F.col("size") / LEAF) / math.log(1 / similarity))
        level = large.select(
            "node", "class", "color", "tokens",
            F.greatest(F.lit(1), F.least(F.lit(MAX_JUMP), steps)).cast("int").alias("jump"),
        )
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, links


def near_duplicates(
    docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, trees: int = TREES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept, component.

    Texts are cut into words at ASCII blanks, A-Z lower-cased. A document's set holds its distinct shingles of
    ``words`` words; a shorter text is one shingle; a null text, or one without words, has an empty set and is
    linked with nothing. Documents are linked if intersection / union is at least ``numerator`` /
    ``denominator``. ``component_id`` is the smallest doc_id reachable through links; ``kept`` says that it
    is the row's own. Null doc_ids are larger than any other; rows with equal doc_id are rows of their
    own, each kept if the id is. ``text_hash`` is the xxhash64 of the text. ``component`` names the group also where several
    have one component_id, as null ids or repeated ones can; null for empty sets. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    described = saved(
        rows.mapInArrow(
            _describe(words),
            "doc_id long, text_hash long, n_shingles long, class binary, tokens binary",
        ),
        scratch_path(spark, "near-sets"),
    )
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    filled = described.where(F.col("class").isNotNull())
    classes = saved(
        filled.groupBy("class").agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct(key.alias("k"), "text_hash")).alias("where"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("tokens").alias("tokens"),
        ),
        scratch_path(spark, "near-classes"),
    )
    texts = rows.select(key.alias("k"), "text_hash", "text")
    leaves, stars = _leaves(classes, texts, trees, words, numerator, denominator)
    leaves = saved(leaves, scratch_path(spark, "near-leaves"))
    candidates = (
        leaves.join(classes.select("class", "n_shingles", "tokens"), "class")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(_leaf_pairs(numerator, denominator), "a binary, b binary")
    )
    clusters = saved(
        components(candidates.unionByName(stars))
        .select(F.col("node").alias("class"), "component")
        .join(classes.select("class", "n_shingles", "where"), "class"),
        scratch_path(spark, "near-clusters"),
    )
    small = clusters.groupBy("component").agg(
        ((F.sum("n_shingles") <= CLUSTER_SHINGLES) & (F.count(F.lit(1)) <= CLUSTER_CLASSES)).alias("small")
    )
    marked = clusters.join(small, "component")
    whole = marked.where("small").select(F.xxhash64("component").alias("group"), "class", "where")
    by_leaf = (
        marked.where(~F.col("small"))
        .join(leaves, "class")
        .select(F.xxhash64("component", "node").alias("group"), "class", "where")
    )
    members = whole.unionByName(by_leaf).select(
        "group", "class", F.col("where.k").alias("k"), F.col("where.text_hash").alias("text_hash")
    )
    links = saved(
        members.join(texts, ["k", "text_hash"])
        .select("group", "class", "text")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(_confirmed(words, numerator, denominator), "a binary, b binary"),
        scratch_path(spark, "near-links"),
    )
    named = classes.select("class", "first_id").join(
        components(links.unionByName(stars)).withColumnRenamed("node", "class"), "class", "left"
    ).withColumn("component", F.coalesce("component", "class"))
    named = saved(named, scratch_path(spark, "near-components"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(ids, "component").select("class", "component_id", "component")
    return described.join(of_class, "class", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(
            F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        ).alias("kept"),
        "component",
    )

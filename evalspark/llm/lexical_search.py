"""Ranked search for documents by terms, over bit-sliced Bloom signatures.

The index holds blocks of documents of similar size. A block is a bit matrix: a row (slice) for each bit of the
signatures, a column for each document, so the documents that may hold a term are the conjunction of a few slices.
A term is entered again for each doubling of its occurrences, so the slices also bound how often it
occurs. Both overestimate, so the sum over a query's terms of the weighted bounds is never below a document's
score. The documents with the highest bounds are scored exactly; the tenth best of their scores excludes all
documents whose bound is lower, and all others are scored exactly from their texts.

The queries travel to the tasks as files in the shared folder, in blocks; the index is scanned, never shuffled.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import filesystem, mix64, saved, slices, utf8
from evalspark.operators.sizes import broadcast_if_small
from evalspark.session import scratch_path

# Fixed values of the ranking: weights are in thousandths, the share of a text's length in its score in percent.
SCALE = 1000
LENGTH_SHARE = 90
SATURATION = 8

PROBES = 5
BITS_PER_KEY = 12
# so many times ``top`` documents of highest bound are scored first, as some owe their bound to false presence
PILOT = 4
# a term that occurs 2**i times is entered i + 1 times, at most so often
LEVELS = 6
BLOCK_DOCS = 4096
# bits of a block's matrix, and of a signature: longer documents have denser signatures, which bound less tightly
BLOCK_BITS = 1 << 26
MOST_BITS = 1 << 22
ITEMS_PER_BLOCK = 256
# items scored at a time against a block of documents
ITEM_CHUNK = 32
OPEN_BLOCKS = 4

_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())
SIGNATURES = (
    "bits int, doc_ids array<bigint>, lengths array<bigint>, digests binary, slices binary, "
    "n_docs bigint, n_terms bigint"
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of anything beyond ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split()


def length_factor(n: int, docs: int, terms: int) -> int:
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // terms


def _probes(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The slices of each key at a level: one row of ``PROBES`` numbers a key."""
    mixed = mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    start = mixed & np.uint64(0xFFFFFFFF)
    turns = np.arange(PROBES, dtype=np.uint64)
    return ((start[:, None] + turns * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _term_keys(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms))


class _Pending:
    """Documents of one size class that wait for their block to fill."""

    def __init__(self, size_class: int):
        self.bits = min(BITS_PER_KEY << size_class, MOST_BITS)
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // self.bits) // 8 * 8)
        self.rows: list[tuple] = []

    def block(self) -> dict:
        matrix = np.zeros((self.bits, -(-len(self.rows) // 8) * 8), dtype=bool)
        for column, (_, _, _, keys, levels) in enumerate(self.rows):
            for level in range(int(levels.max())):
                matrix[_probes(keys[levels > level], level, self.bits), column] = True
        return {
            "bits": self.bits,
            "doc_ids": [r[0] for r in self.rows],
            "lengths": [r[1] for r in self.rows],
            "digests": b"".join(r[2] for r in self.rows),
            "slices": np.packbits(matrix, axis=1).tobytes(),
            "n_docs": len(self.rows),
            "n_terms": sum(r[1] for r in self.rows),
        }


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("bits", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("digests", pa.binary()),
            ("slices", pa.binary()),
            ("n_docs", pa.int64()),
            ("n_terms", pa.int64()),
        ]
    )
    pending: dict[int, _Pending] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            ids, digests = part.column("doc_id").to_pylist(), part.column("digest").to_pylist()
            lists = [terms_of(t) for t in utf8(part, "text")]
            numbers: dict[bytes, int] = {}
            flat = np.fromiter(
                (numbers.setdefault(t, len(numbers)) for t in itertools.chain.from_iterable(lists)), dtype=np.int64
            )
            hashes = _term_keys(list(numbers))
            ends = np.cumsum([len(x) for x in lists])
            for doc_id, digest, terms, end in zip(ids, digests, lists, ends.tolist()):
                if not terms:
                    continue
                own, counts = np.unique(flat[end - len(terms) : end], return_counts=True)
                levels = np.minimum(np.log2(counts).astype(np.int64) + 1, LEVELS)
                size_class = max(3, int(levels.sum() - 1).bit_length())
                held = pending.setdefault(size_class, _Pending(size_class))
                held.rows.append((doc_id, len(terms), digest, hashes[own], levels))
                if len(held.rows) >= held.room:
                    yield pa.RecordBatch.from_pylist([pending.pop(size_class).block()], schema)
    for held in pending.values():
        yield pa.RecordBatch.from_pylist([held.block()], schema)


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``digest``, 128 bits by which equal texts are known."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def build_signatures(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The index of all documents that have a term: a row for each block, written to ``path``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts, and texts without a term, are
    in no block, as no query finds them. Repeated rows are documents of their own.
    """
    path = path or scratch_path(docs.sparkSession, "signatures")
    return saved(_identified(docs).mapInArrow(_signed, SIGNATURES), path)


class _Files:
    """Blocks of a table partitioned by ``block`` in the shared folder; a few are kept open."""

    def __init__(self, path: str, blocks: int, parse):
        self.path, self.blocks, self.parse = path, blocks, parse
        self.open: dict[int, object] = {}

    def block(self, number: int):
        if number not in self.open:
            if len(self.open) >= OPEN_BLOCKS:
                self.open.pop(next(iter(self.open)))
            files, root = filesystem(f"{self.path}/block={number}")
            rows = [
                row
                for info in files.get_file_info(FileSelector(root, allow_not_found=True))
                if info.path.endswith(".parquet")
                for row in pq.ParquetFile(files.open_input_file(info.path)).read().to_pylist()
            ]
            self.open[number] = self.parse(rows)
        return self.open[number]

    def __iter__(self):
        return (self.block(i) for i in range(self.blocks))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = zip(part.column("item").to_pylist(), utf8(part, "text"))
            pairs = [(item, term) for item, text in rows for term in dict.fromkeys(terms_of(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())],
                names=["item", "term"],
            )


def _occurrences(path: str, blocks: int):
    """How many documents hold each query term, for those of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, blocks, lambda rows: {r["term"] for r in rows})
        for batch in batches:
            for part in slices(batch, "text", 32 << 20):
                sets = [set(terms_of(t)) for t in utf8(part, "text")]
                found: Counter[bytes] = Counter()
                for wanted in files:
                    for own in sets:
                        found.update(own & wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    names=["term", "df"],
                )

    return count


class _Queries:
    """A block of items with the weights of their terms."""

    def __init__(self, rows: list[dict]):
        self.terms: dict[int, dict[bytes, int]] = {}
        self.limits: dict[int, tuple[int, int | None]] = {}
        for r in rows:
            self.terms.setdefault(r["item"], {})[r["term"]] = r["weight"]
            self.limits[r["item"]] = (r.get("least", 1), r.get("last_id"))

    def chunks(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]]:
        items = sorted(self.terms)
        for i in range(0, len(items), ITEM_CHUNK):
            chosen = items[i : i + ITEM_CHUNK]
            weights = {t: w for item in chosen for t, w in self.terms[item].items()}
            place = {t: n for n, t in enumerate(weights)}
            rows = [np.array([place[t] for t in self.terms[item]], dtype=np.int64) for item in chosen]
            yield chosen, _term_keys(list(weights)), np.array(list(weights.values()), dtype=np.int64), rows


def _bounds(
    matrix: np.ndarray, lengths: np.ndarray, factors: np.ndarray, keys: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """For each term and document of a block, at least what the term adds to the document's score."""

    def present(level: int) -> np.ndarray:
        picked = matrix[_probes(keys, level, len(matrix))]
        return np.unpackbits(np.bitwise_and.reduce(picked, axis=1), axis=1, count=len(lengths)).astype(bool)

    term, doc = np.nonzero(present(0))
    level = np.zeros(len(term), dtype=np.int64)
    alive = np.ones(len(term), dtype=bool)
    for i in range(1, LEVELS):
        alive &= present(i)[term, doc]
        if not alive.any():
            break
        level += alive
    most = np.minimum(np.where(level == LEVELS - 1, lengths[doc], (2 << level) - 1), lengths[doc])
    bounds = np.zeros((len(keys), len(lengths)))
    parts = (1_000_000 * SCALE * most) // (SCALE * most + SATURATION * factors[doc])
    bounds[term, doc] = weights[term] * parts  # integers below 2**53
    return bounds


def _copy_rank(digests: np.ndarray, doc_ids: list) -> np.ndarray:
    """Place of each document among those of equal text, by doc_id (null last)."""
    places = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, i))
    seen: Counter[bytes] = Counter()
    rank = np.zeros(len(doc_ids), dtype=np.int64)
    for i in places:
        digest = digests[i].tobytes()
        rank[i] = seen[digest]
        seen[digest] += 1
    return rank


def _candidates(path: str, blocks: int, docs: int, terms: int, top: int, best_only: bool):
    """By block of documents, the items' documents of highest bound, or all that aren't excluded."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, blocks, _Queries)
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in ("bits", "doc_ids", "lengths", "digests")}
                raw = np.frombuffer(batch.column("slices")[row].as_buffer(), dtype=np.uint8)
                matrix = raw.reshape(block["bits"], -1)
                lengths = np.array(block["lengths"], dtype=np.int64)
                factors = np.array([length_factor(n, docs, terms) for n in block["lengths"]], dtype=np.int64)
                digests = np.frombuffer(block["digests"], dtype=np.uint8).reshape(-1, 16)
                # of equal texts only the first ``top`` can be among the best
                first = _copy_rank(digests, block["doc_ids"]) < top
                last = 1 << 63
                ids = np.array([last if i is None else i for i in block["doc_ids"]], dtype=object)
                found: list[tuple] = []
                for number, queries in enumerate(files):
                    for items, keys, weights, rows in queries.chunks():
                        bounds = _bounds(matrix, lengths, factors, keys, weights)
                        for item, own in zip(items, rows):
                            sums = bounds[own].sum(axis=0)
                            least, last_id = queries.limits[item]
                            open_ = np.flatnonzero((sums >= least) & first)
                            if last_id is not None:  # equal scores go by doc_id
                                open_ = open_[(sums[open_] > least) | (ids[open_] <= last_id)]
                            if best_only and len(open_) > PILOT * top:
                                open_ = open_[np.argsort(-sums[open_], kind="stable")[: PILOT * top]]
                            found += [(number, item, int(d), int(sums[d])) for d in open_]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f[0] for f in found], pa.int32()),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([block["doc_ids"][f[2]] for f in found], pa.int64()),
                        pa.array([digests[f[2]].tobytes() for f in found], pa.binary()),
                        pa.array([f[3] for f in found], pa.int64()),
                    ],
                    names=["block", "item", "doc_id", "digest", "bound"],
                )

    return find


def _exact(path: str, blocks: int, docs: int, terms: int):
    """Scores of texts for the items that name them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, blocks, _Queries)
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                wanted = zip(utf8(part, "text"), part.column("digest").to_pylist(), part.column("items").to_pylist())
                for text, digest, items in wanted:
                    words = terms_of(text)
                    counts = Counter(words)
                    added = SATURATION * length_factor(len(words), docs, terms)
                    for item in sorted(items, key=lambda i: (i["block"], i["item"])):
                        total = 0
                        for term, weight in files.block(item["block"]).terms[item["item"]].items():
                            if tf := counts.get(term):
                                total += weight * (1_000_000 * SCALE * tf // (SCALE * tf + added))
                        out.append((item["item"], digest, total))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.binary()),
                        pa.array([o[2] for o in out], pa.int64()),
                    ],
                    names=["item", "digest", "score"],
                )

    return score


def _ranked(rows: DataFrame, by: str, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, signatures: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents of each item, scores above 0 only.

    ``signatures`` is the index of ``docs`` (``build_signatures``); ``items`` needs ``item_id`` and ``text``. Every
    row of ``items`` is a query of its own; without terms (null or empty texts) it finds nothing. Equal
    scores rank by ascending doc_id, null last; repeated rows each have a rank. Equal texts are known by a 128-bit
    digest. Tables that are empty give an empty result.

    Document texts are scanned for the terms' frequencies and twice for the candidates; only candidates' texts move.
    """
    spark = docs.sparkSession
    size = signatures.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    count, terms = size["n"] or 0, size["terms"] or 0
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    queries = saved(numbered, scratch_path(spark, "search-items"))
    blocks = -(-queries.count() // ITEMS_PER_BLOCK)
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))).cast("int")
    wanted = saved(
        queries.mapInArrow(_query_terms, "item bigint, term binary").withColumn("block", block),
        scratch_path(spark, "search-terms"),
        "block",
    )
    identified = _identified(docs)
    term_path = scratch_path(spark, "search-distinct-terms")
    wanted.select("block", "term").distinct().write.partitionBy("block").parquet(term_path)
    # a term of several blocks is counted once for each of them
    found = identified.select("text").mapInArrow(_occurrences(term_path, blocks), "term binary, df bigint")
    repeats = wanted.groupBy("term").agg(F.countDistinct("block").alias("n"))
    df = found.groupBy("term").agg(F.sum("df").alias("df")).join(repeats, "term")
    odds = (2.0 * count + 2.0) / (2.0 * F.col("df") / F.col("n") + 1.0)
    weight = F.floor(F.lit(float(SCALE)) * F.log(odds)).cast("bigint")
    weights = df.select("term", weight.alias("weight"))
    weighted_path = scratch_path(spark, "search-weights")
    weighted = saved(wanted.join(weights, "term").select("item", "term", "weight", "block"), weighted_path, "block")

    def candidates(path: str, best_only: bool) -> DataFrame:
        task = _candidates(path, blocks, count, terms, top, best_only)
        schema = "block int, item bigint, doc_id bigint, digest binary, bound bigint"
        return signatures.select("bits", "doc_ids", "lengths", "digests", "slices").mapInArrow(task, schema)

    def scored(rows: DataFrame) -> DataFrame:
        by_text = rows.groupBy("digest").agg(F.collect_set(F.struct("block", "item")).alias("items"))
        named = saved(by_text, scratch_path(spark, "search-texts"))
        few = broadcast_if_small(named.select("digest"))
        texts = identified.select("digest", "text").join(few, "digest", "left_semi")
        chosen = texts.dropDuplicates(["digest"]).join(named, "digest")
        scores = chosen.select("digest", "text", "items").mapInArrow(
            _exact(weighted_path, blocks, count, terms), "item bigint, digest binary, score bigint"
        )
        return rows.join(scores, ["item", "digest"]).where("score > 0").select("item", "doc_id", "score")

    best = _ranked(candidates(weighted_path, best_only=True), "bound", PILOT * top).drop("rank")
    reached = _ranked(scored(saved(best, scratch_path(spark, "search-best"))), "score", top)
    limit = reached.where(F.col("rank") == top).select(
        "item", F.col("score").alias("least"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("last_id")
    )
    limited_path = scratch_path(spark, "search-limits")
    limits = weighted.join(limit, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("bigint")))
    limits.write.partitionBy("block").parquet(limited_path)
    rest = saved(candidates(limited_path, best_only=False), scratch_path(spark, "search-candidates"))
    ranked = _ranked(scored(rest), "score", top)
    return ranked.join(queries.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )

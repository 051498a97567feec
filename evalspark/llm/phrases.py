"""Phrases whose words occur together more often than apart, by language.

Words that are frequent enough get numbers; texts become streams of numbers, once. N-grams are counted by length in
counting quotient filters: every task sorts its n-grams into filters by shard, and a shard's filters are merged where
it is owned. No longer phrase is more frequent than its parts, so from three words on a task enters only n-grams
both of whose shorter parts may be frequent, as a bitmap of bounded size tells; the bitmap passes some that aren't,
which the counts then reject, and no one that is.
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

from evalspark.llm import quotient_filter
from evalspark.llm.common import filesystem, mix64, saved, slices, utf8
from evalspark.llm.quotient_filter import Layout
from evalspark.session import scratch_path

NO_LANG = "und"
TEXT_BYTES = 8 << 20
BUCKETS = 64
# numbers of the words of a bucket stay open up to so many words
OPEN_WORDS = 8 << 20
KNOWN_WORDS = 1 << 18
# entries that a task holds before it writes filters, and words of text for each shard
FILTER_ENTRIES = 1 << 21
SHARD_WORDS = 1 << 22
LEAST_SHARD_BITS = 5
# bits of the bitmap of frequent phrases for each of them, and at most
BITMAP_BITS = 16
MOST_BITMAP_BITS = 1 << 30
SEGMENT_BITS = 1 << 20
# Fixed value: the byte that stands for the end of a piece, which UTF-8 never has.
_END = b"\xff"
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_PIECE_ENDS + _UPPER + b"\t", _END * len(_PIECE_ENDS) + _UPPER.lower() + b" ")


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts in order, with ``_END`` between pieces and texts."""
    return _END.join(texts).translate(_FOLD).replace(_END, b" " + _END + b" ").split(b" ")


def _by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), utf8(part, "text")):
        texts.setdefault(NO_LANG if lang is None else lang, []).append(text)
    for lang, own in texts.items():
        yield lang, [w for w in words_of(own) if w]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, and of all (a null word)."""
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            for lang, words in _by_lang(part):
                counts = Counter(words)
                counts.pop(_END, None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(counts) + 1), pa.string()),
                        pa.array([None, *counts], pa.binary()).cast(pa.string()),
                        pa.array([counts.total(), *counts.values()], pa.int64()),
                    ],
                    names=["lang", "word", "n"],
                )


def _digest(lang: bytes, word: bytes) -> bytes:
    return xxhash.xxh3_128_digest(lang + b"\x00" + word)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = b"".join(map(_digest, utf8(batch, "lang"), utf8(batch, "word")))
        halves = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        ids = batch.column("id")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(halves[:, 0].view(np.int64)),
                pa.array(halves[:, 1].view(np.int64)),
                ids,
                pa.array((halves[:, 0] % np.uint64(BUCKETS)).astype(np.int32)),
            ],
            names=["h1", "h2", "id", "bucket"],
        )


def _files(path: str) -> Iterator[pa.Table]:
    files, root = filesystem(path)
    for info in files.get_file_info(FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            yield pq.ParquetFile(files.open_input_file(info.path)).read()


class _Numbers:
    """Numbers of words by their hash, read from the shared folder bucket by bucket."""

    def __init__(self, path: str):
        self.path = path
        self.open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.known: dict[tuple[str, bytes], int] = {}

    def _bucket(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if number not in self.open:
            tables = list(_files(f"{self.path}/bucket={number}"))
            columns = [
                np.concatenate([np.asarray(t.column(name)) for t in tables] or [np.zeros(0, np.int64)])
                for name in ("h1", "h2", "id")
            ]
            order = np.argsort(columns[0].view(np.uint64), kind="stable")
            h1, h2, ids = (c[order] for c in columns)
            while self.open and len(h1) + sum(len(x[0]) for x in self.open.values()) > OPEN_WORDS:
                self.open.pop(next(iter(self.open)))
            self.open[number] = (h1.view(np.uint64), h2.view(np.uint64), ids)
        return self.open[number]

    def _look_up(self, lang: str, words: list[bytes]) -> None:
        prefix = lang.encode()
        halves = np.frombuffer(b"".join(_digest(prefix, w) for w in words), dtype="<u8").reshape(-1, 2)
        found = np.full(len(words), -1, dtype=np.int64)
        home = halves[:, 0] % np.uint64(BUCKETS)
        for number in np.unique(home).tolist():
            rows = np.flatnonzero(home == number)
            h1, h2, ids = self._bucket(number)
            at = np.searchsorted(h1, halves[rows, 0])
            # words of equal first halves stand together
            while len(rows):
                inside = at < len(h1)
                rows, at = rows[inside], at[inside]
                same = h1[at] == halves[rows, 0]
                rows, at = rows[same], at[same]
                hit = h2[at] == halves[rows, 1]
                found[rows[hit]] = ids[at[hit]]
                rows, at = rows[~hit], at[~hit] + 1
        self.known.update(zip(((lang, w) for w in words), found.tolist()))

    def stream(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; -1 for the end of a piece and for words without one, never twice in a row."""
        distinct = set(words)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        if new := [w for w in distinct if (lang, w) not in self.known]:
            self._look_up(lang, new)
        numbers = {w: self.known[lang, w] for w in distinct}
        numbers[_END] = -1
        ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        keep = np.ones(len(ids), dtype=bool)
        keep[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0)
        return ids[keep]


def _streams(path: str):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(path)
        for batch in batches:
            for part in slices(batch, "text"):
                streams = [numbers.stream(lang, words) for lang, words in _by_lang(part) if words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(s + 1).astype("<u4").tobytes() for s in streams], pa.binary())], names=["ids"]
                )

    return number


class _Bitmap:
    """The bitmap of frequent phrases, as tasks read it."""

    def __init__(self, path: str, bits: int):
        self.bits = bits
        self.bytes = np.zeros(-(-bits // SEGMENT_BITS) * SEGMENT_BITS // 8, dtype=np.uint8)
        for table in _files(path):
            for segment, raw in zip(table.column("segment").to_pylist(), table.column("bitmap").to_pylist()):
                start = segment * (SEGMENT_BITS // 8)
                self.bytes[start : start + SEGMENT_BITS // 8] = np.frombuffer(raw, np.uint8)

    def may_have(self, limbs: np.ndarray) -> np.ndarray:
        out = np.ones(limbs.shape[1], dtype=bool)
        for at in _bitmap_places(limbs, self.bits):
            out &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _bitmap_places(limbs: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = np.zeros(limbs.shape[1], dtype=np.uint64)
    for limb in limbs:
        mixed = mix64(mixed ^ limb + np.uint64(1))
    return [(x % np.uint64(bits)).astype(np.int64) for x in (mixed, mix64(mixed))]


def _grams(ids: np.ndarray, words: int, shorter: _Bitmap | None, bits: int) -> list[np.ndarray]:
    """Columns of the n-grams of a stream whose shorter parts may all be frequent."""
    starts = np.ones(max(0, len(ids) - words + 1), dtype=bool)
    for i in range(words):
        starts &= ids[i : i + len(starts)] >= 0
    at = np.flatnonzero(starts)
    if shorter is not None and len(at):
        part = Layout(words - 1, bits)
        for first in (0, 1):
            columns = [ids[at + first + i] for i in range(words - 1)]
            at = at[shorter.may_have(quotient_filter.pack(columns, part))]
    return [ids[at + i] for i in range(words)]


def _filters(layout: Layout, bitmap: str | None, bitmap_bits: int):
    """Filters, by shard, of the n-grams in a task's streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = _Bitmap(bitmap, bitmap_bits) if bitmap else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        new = 0

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            return quotient_filter.merged(
                np.concatenate([limbs for limbs, _ in held], axis=1), np.concatenate([counts for _, counts in held])
            )

        def written(limbs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            filters = quotient_filter.split(limbs, counts, layout)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in filters], pa.int64()), pa.array([f[1] for f in filters], pa.binary())],
                names=["shard", "filter"],
            )

        for batch in batches:
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u4").astype(np.int64) - 1
                for start in range(0, len(ids), FILTER_ENTRIES):
                    piece = ids[start : start + FILTER_ENTRIES + layout.words - 1]
                    columns = _grams(piece, layout.words, shorter, layout.bits)
                    limbs = quotient_filter.permute(quotient_filter.pack(columns, layout), layout)
                    held.append((limbs, np.ones(limbs.shape[1], dtype=np.int64)))
                    new += limbs.shape[1]
                    if new >= FILTER_ENTRIES:
                        held[:] = [gathered()]
                        new = 0
                        if held[0][0].shape[1] >= FILTER_ENTRIES // 2:
                            yield written(*held.pop())
        if held:
            yield written(*gathered())

    return count


def _frequent(layout: Layout, min_count: int):
    """The n-grams of a shard that are frequent, from the shard's filters."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        held, entries = [], 0
        limbs = np.zeros((len(layout.widths), 0), dtype=np.uint64)
        counts = np.zeros(0, dtype=np.int64)
        for raw in itertools.chain(table.column("filter"), [None]):
            if raw is not None:
                held.append(quotient_filter.decode(raw.as_buffer(), shard, layout))
                entries += len(held[-1][1])
            if raw is None or entries >= FILTER_ENTRIES:
                limbs, counts = quotient_filter.merged(
                    np.concatenate([limbs, *(h[0] for h in held)], axis=1),
                    np.concatenate([counts, *(h[1] for h in held)]),
                )
                held, entries = [], 0
        often = counts >= min_count
        columns = quotient_filter.unpack(quotient_filter.restore(limbs[:, often], layout), layout)
        ids = np.stack(columns, axis=1).astype(np.int64)
        flat = pa.array(ids.reshape(-1), pa.int64())
        offsets = pa.array(np.arange(len(ids) + 1) * layout.words, pa.int32())
        return pa.table({"ids": pa.ListArray.from_arrays(offsets, flat), "a": pa.array(counts[often])})

    return merge


def _places(layout: Layout, bits: int):
    """Where the bitmap has a bit for each frequent n-gram."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("ids").flatten()).reshape(-1, layout.words)
            limbs = quotient_filter.pack(list(ids.T), layout)
            at = np.concatenate(_bitmap_places(limbs, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // SEGMENT_BITS), pa.array((at % SEGMENT_BITS).astype(np.int32))], names=["segment", "bit"]
            )

    return place


def _segment(table: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, dtype=bool)
    bits[np.asarray(table.column("bit"))] = True
    raw = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"segment": pa.array([table.column("segment")[0].as_py()]), "bitmap": pa.array([raw], pa.binary())})


def _numbered(words: DataFrame) -> DataFrame:
    """Words with numbers from 0 without gaps: by bucket, each bucket after those before it."""
    bucketed = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))  # at most BUCKETS rows
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return (
        bucketed.withColumn("place", place)
        .join(F.broadcast(starts), "bucket")
        .select("lang", "word", "n", (F.col("start") + F.col("place") - 1).alias("id"))
    )


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``lang, word, n, id``), phrases (``ids, a``) and ``lang, total`` of all documents.

    Words and phrases with at least ``min_count`` occurrences, phrases of one to ``max_words`` word ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_word_counts, "lang string, word string, n bigint")
    often = saved(
        counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(f"word IS NULL OR n >= {int(min_count)}"),
        scratch_path(spark, "phrase-words"),
    )
    totals = often.where("word IS NULL").select("lang", F.col("n").alias("total"))
    words = saved(_numbered(often.where("word IS NOT NULL")), scratch_path(spark, "phrase-numbers"))
    phrases = words.select(F.array("id").alias("ids"), F.col("n").alias("a"))
    found = words.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).first()
    if not found["words"]:
        return words, phrases, totals
    bits = max(1, (found["words"] - 1).bit_length())
    shard_bits = max(LEAST_SHARD_BITS, (found["tokens"] // SHARD_WORDS).bit_length())
    dictionary = scratch_path(spark, "phrase-dictionary")
    hashed = words.select("lang", "word", "id").mapInArrow(_hashed, "h1 bigint, h2 bigint, id bigint, bucket int")
    hashed.repartition("bucket").write.partitionBy("bucket").parquet(dictionary)
    streams = saved(rows.mapInArrow(_streams(dictionary), "ids binary"), scratch_path(spark, "phrase-streams"))

    bitmap, bitmap_bits = None, 0
    for length in range(2, max_words + 1):
        layout = Layout(length, bits, shard_bits)
        filters = streams.mapInArrow(_filters(layout, bitmap, bitmap_bits), "shard bigint, filter binary")
        frequent = saved(
            filters.groupBy("shard").applyInArrow(_frequent(layout, min_count), "ids array<bigint>, a bigint"),
            scratch_path(spark, f"phrases-{length}"),
        )
        phrases = phrases.unionByName(frequent)
        known = frequent.count()
        if not known:
            break
        if length < max_words:
            bitmap_bits = min(MOST_BITMAP_BITS, max(SEGMENT_BITS, known * BITMAP_BITS))
            bitmap = scratch_path(spark, f"phrase-bitmap-{length}")
            places = frequent.select("ids").mapInArrow(_places(layout, bitmap_bits), "segment bigint, bit int")
            segments = places.groupBy("segment").applyInArrow(_segment, "segment bigint, bitmap binary")
            segments.write.parquet(bitmap)
    return words, phrases, totals


def mine_phrases(
    docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, absorb_percent: int = 100
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score.

    Needs ``lang`` (null: ``und``) and ``text`` (null: empty); other columns are ignored. A-Z are lower-cased, texts
    are cut at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words; phrases lie within pieces. Every
    row counts, repeated ones too. A phrase with ``a`` occurrences, at least ``min_count``, is cut after its first words so
    that the score ``1000 * a * n / (l * r)``, rounded down, is lowest (the shortest first part of equal ones);
    ``l`` and ``r`` are the occurrences of its parts, ``n`` of all words. Phrases within a longer one that has ``absorb_percent`` of
    their occurrences are left out. Equal scores rank by ``a``, then by the phrase's bytes. Without phrases the result is empty.

    Numbers have up to 38 digits before the division. Words are told apart by 128-bit hashes while texts are numbered;
    there may be 2**32 frequent ones.
    """
    words, phrases, totals = frequent_phrases(docs, min_count, max_words)
    spark = docs.sparkSession
    phrases = saved(phrases, scratch_path(spark, "phrases"))
    longer = phrases.where(F.size("ids") > 1)
    # the most frequent phrase with one more word decides: what contains a longer one contains it too
    inner = longer.where(F.size("ids") > 2).select(
        F.explode(
            F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))
        ).alias("ids"),
        F.col("a").alias("longest"),
    )
    held = inner.groupBy("ids").agg(F.max("longest").alias("longest"))
    kept = longer.join(held, "ids", "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < absorb_percent * F.col("a"))
    )
    cuts = kept.select(
        "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    ).selectExpr("ids", "a", "k", "slice(ids, 1, k) AS head", "slice(ids, k + 1, size(ids) - k) AS rest", "ids[0] AS id")
    language = words.select("id", "lang").join(totals, "lang").withColumnRenamed("total", "n")
    scored = (
        cuts.join(phrases.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head")
        .join(phrases.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
        .join(language, "id")
        .withColumn("score", F.expr("(1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * r)"))
        .groupBy("ids", "lang", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("ids", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    )
    order = [F.col("score").desc(), F.col("a").desc()]
    near_top = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    best = saved(scored.withColumn("place", near_top).where(F.col("place") <= top), scratch_path(spark, "best-phrases"))
    spelled = (
        best.select("ids", F.posexplode("ids").alias("position", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("ids")
        .agg(F.sort_array(F.collect_list(F.struct("position", "word"))).alias("parts"))
        .select("ids", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (
        best.join(spelled, "ids")
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )

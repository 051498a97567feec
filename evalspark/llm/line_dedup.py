"""Removal of lines that many documents share.

The 128-bit hashes of all lines are counted by document. Those that reach the threshold go into
a sharded minimal perfect hash: a shard maps each of its keys to a slot without storing the key;
two arrays hold, by slot, the key's fingerprint and its count. Documents stay where they are and
probe the arrays: a line that isn't in the index meets a slot whose fingerprint differs. No line
text and no line row is joined or moved; only hashes are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import (
    filesystem,
    mix64,
    output_schema,
    replaced,
    saved,
    slices,
    utf8,
)
from evalspark.session import scratch_path

SHARD_KEYS = 1 << 19
# bits of a level for each key that is still without a slot
LEVEL_BITS = 2
OPEN_SHARDS = 4


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Key of each line: ASCII blanks stripped, A-Z lower-cased; too short keys become empty."""
    keys = [line.strip() for line in text.lower().split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]
    return keys


def _hash_counts(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                found: Counter[bytes] = Counter()
                for text in utf8(part, "text"):
                    keys = set(line_keys(text, min_chars))
                    keys.discard(b"")
                    found.update(map(digest, keys))
                halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["h1", "h2", "n"],
                )

    return count


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(h1 ^ mix64(h2 ^ seed)) % np.uint64(size)).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> dict:
    """Levels of bits, and fingerprints and counts by slot, of distinct 128-bit keys.

    At each level the keys that hit a bit alone get it; the others go on to the next level.
    A key's slot is the number of set bits before its own.
    """
    levels: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    rest = np.arange(len(h1))
    while len(rest):
        size = max(64, -(-len(rest) * LEVEL_BITS // 64) * 64)
        at = _positions(h1[rest], h2[rest], len(levels), size)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        order = np.argsort(at[alone], kind="stable")
        owners.append(rest[alone][order])
        levels.append(bits)
        rest = rest[~alone]
    slots = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    return {
        "levels": [np.packbits(b, bitorder="little").tobytes() for b in levels],
        "fingerprints": h2[slots].astype("<u8").tobytes(),
        "counts": np.minimum(counts[slots], 0xFFFFFFFF).astype("<u4").tobytes(),
    }


class Shard:
    """A shard opened for probing."""

    def __init__(self, stored: dict):
        self.fingerprints = np.frombuffer(stored["fingerprints"], dtype="<u8")
        self.counts = np.frombuffer(stored["counts"], dtype="<u4")
        self.levels = []
        before = 0
        for raw in stored["levels"]:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
            rank = before + np.cumsum(bits, dtype=np.int32) - bits
            before += int(bits.sum())
            self.levels.append((bits.astype(bool), rank.astype(np.int32)))

    def counts_of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Count of each key; 0 for keys that aren't in the shard."""
        slot = np.full(len(h1), -1, dtype=np.int64)
        rest = np.arange(len(h1))
        for level, (bits, rank) in enumerate(self.levels):
            at = _positions(h1[rest], h2[rest], level, len(bits))
            hit = bits[at]
            slot[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        out = np.zeros(len(h1), dtype=np.int64)
        seen = slot >= 0
        same = self.fingerprints[slot[seen]] == h2[seen]
        out[np.flatnonzero(seen)[same]] = self.counts[slot[seen][same]]
        return out


def _build(table: pa.Table) -> pa.Table:
    column = lambda name: np.asarray(table.column(name))
    stored = build_shard(
        column("h1").astype(np.int64).view(np.uint64),
        column("h2").astype(np.int64).view(np.uint64),
        column("n").astype(np.int64),
    )
    return pa.table(
        {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
            "levels": pa.array([stored["levels"]], pa.list_(pa.binary())),
            "fingerprints": pa.array([stored["fingerprints"]], pa.binary()),
            "counts": pa.array([stored["counts"]], pa.binary()),
        }
    )


class Index:
    """The shards in the shared folder; a few are open at a time."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards
        self.open: dict[int, Shard | None] = {}

    def shard(self, number: int) -> Shard | None:
        if number not in self.open:
            if len(self.open) >= OPEN_SHARDS:
                self.open.pop(next(iter(self.open)))
            files, root = filesystem(f"{self.path}/shard={number}")
            from pyarrow.fs import FileSelector

            found = [
                info.path
                for info in files.get_file_info(FileSelector(root, allow_not_found=True))
                if info.path.endswith(".parquet")
            ]
            rows = [r for p in found for r in pq.ParquetFile(files.open_input_file(p)).read().to_pylist()]
            self.open[number] = Shard(rows[0]) if rows else None
        return self.open[number]

    def counts_of(self, digests: list[bytes]) -> np.ndarray:
        halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        h1, h2 = halves[:, 0], halves[:, 1]
        home = h1.view(np.int64) % self.shards
        out = np.zeros(len(digests), dtype=np.int64)
        order = np.argsort(home, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(rows) and (shard := self.shard(int(home[rows[0]]))) is not None:
                out[rows] = shard.counts_of(h1[rows], h2[rows])
        return out


def _probe(path: str, shards: int, min_docs: int, min_chars: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(path, shards) if shards else None
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                texts = utf8(part, "text")
                keys = [line_keys(text, min_chars) for text in texts]
                distinct = list({k for ks in keys for k in ks if k})
                common: set[bytes] = set()
                if index is not None and distinct:
                    counts = index.counts_of([digest(k) for k in distinct])
                    common = {distinct[i] for i in np.flatnonzero(counts >= min_docs)}
                kept, dropped = [], []
                for text, ks in zip(texts, keys):
                    if common.isdisjoint(ks):
                        kept.append(text)
                        dropped.append(0)
                        continue
                    lines = [x for x, k in zip(text.split(b"\n"), ks) if k not in common]
                    kept.append(b"\n".join(lines))
                    dropped.append(len(ks) - len(lines))
                yield replaced(
                    part,
                    {
                        "text": pa.array(kept, pa.binary()).cast(pa.string()),
                        "n_lines": pa.array([len(ks) for ks in keys], pa.int64()),
                        "n_dropped": pa.array(dropped, pa.int64()),
                    },
                )

    return probe


def build_index(docs: DataFrame, min_docs: int, min_chars: int = 1) -> tuple[str, int]:
    """Writes the index of the lines found in at least ``min_docs`` rows: its folder and shards."""
    spark = docs.sparkSession
    counted = (
        docs.select("text")
        .mapInArrow(_hash_counts(min_chars), "h1 long, h2 long, n long")
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_docs)
    )
    common = saved(counted, scratch_path(spark, "line-counts"))
    shards = -(-common.count() // SHARD_KEYS)
    path = scratch_path(spark, "line-index")
    if shards:
        (
            common.withColumn("shard", F.pmod("h1", F.lit(shards)))
            .groupBy("shard")
            .applyInArrow(
                _build, "shard long, levels array<binary>, fingerprints binary, counts binary"
            )
            .write.partitionBy("shard")
            .parquet(path)
        )
    return path, shards


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines gone whose key at least ``min_docs`` rows have.

    A text is split at newlines. A line's key is the line with ASCII blanks stripped at both
    ends and A-Z lower-cased; keys shorter than ``min_chars`` code points never go. All columns
    stay; ``text`` is the kept lines joined by newlines, and ``n_lines`` (before dropping) and
    ``n_dropped`` are added, in place of columns of these names.

    A null or empty text is one empty line and comes back as the empty text. Each row is a
    document, also if its doc_id occurs twice or is null. A line counts once for a document,
    however often it stands there. An empty table gives an empty table.
    """
    path, shards = build_index(docs, min_docs, min_chars)
    return docs.mapInArrow(
        _probe(path, shards, min_docs, min_chars),
        output_schema(docs, {"text": "string", "n_lines": "bigint", "n_dropped": "bigint"}),
    )

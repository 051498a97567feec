"""Token ids packed into matrices of equal rows, by best-fit decreasing.

A task encodes its documents in order and packs them in groups of bounded size. A document longer than a row
is split into full rows and a rest; nothing is dropped. Within a group pieces go from the longest to the
shortest into the row that they fill best: a segment tree over free lengths, whose nodes count the open rows,
finds the least free length that is large enough. Each group is three files in the shared
folder: the matrix of ids, the cumulative lengths of the segments of all rows, and a bit for each
place, set where the position starts at 0. Only files named by the returned table count.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.common import filesystem, saved, slices, strings
from evalspark.session import scratch_path

ROW_TOKENS = 2048
# a group is packed when it has so many tokens; a longer document makes a group of its own
GROUP_TOKENS = 4 << 20

SEGMENTS = (
    "doc_id long, n_tokens long, part int, parts int, file string, row int, start int, length int"
)
_SEGMENT_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("part", pa.int32()),
        ("parts", pa.int32()),
        ("file", pa.string()),
        ("row", pa.int32()),
        ("start", pa.int32()),
        ("length", pa.int32()),
    ]
)


class FreeLengths:
    """Rows by their free length, in a segment tree that finds the least one that is large enough."""

    def __init__(self, largest: int):
        self.size = 1 << largest.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def _count(self, free: int, change: int) -> None:
        node = free + self.size
        while node:
            self.tree[node] += change
            node >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A row of the least free length of at least ``length``, removed; None if there is none."""
        node = length + self.size
        if not self.tree[node]:
            # up until there is an open row to the right, then down to the first one
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node <<= 1
                if not self.tree[node]:
                    node += 1
        free = node - self.size
        self._count(free, -1)
        return self.rows[free].pop(), free


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Row and start of pieces of these lengths, each at most ``capacity``, longest first."""
    open_rows = FreeLengths(capacity)
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    rows = 0
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = open_rows.take(lengths[piece])
        row, free = found if found else (rows, capacity)
        rows += found is None
        places[piece] = (row, capacity - free)
        if free > lengths[piece]:
            open_rows.put(row, free - lengths[piece])
    return places


def load_encoder(path: str, pattern: str):
    """The encoder of a file of ranks: bytes in base64 and their number on each line."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _write(folder: str, name: str, values: np.ndarray) -> None:
    files, root = filesystem(folder)
    with files.open_output_stream(f"{root}/{name}.npy") as out:
        head = np.lib.format.header_data_from_array_1_0(values)
        np.lib.format.write_array_header_1_0(out, head)
        out.write(np.ascontiguousarray(values).tobytes())


def _read(folder: str, name: str) -> np.ndarray:
    files, root = filesystem(folder)
    with files.open_input_file(f"{root}/{name}.npy") as file:
        np.lib.format.read_magic(file)
        shape, _, kind = np.lib.format.read_array_header_1_0(file)
        return np.frombuffer(file.read(), dtype=kind).reshape(shape)


class _Group:
    """Documents gathered until they are packed together."""

    def __init__(self, folder: str, capacity: int, kind: str):
        self.folder, self.capacity, self.kind = folder, capacity, kind
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens)

    def packed(self) -> pa.RecordBatch:
        """Writes the files of the group and returns its segments."""
        size = self.capacity
        owners, pieces, parts = [], [], []
        for number, tokens in enumerate(self.tokens):
            cut = [tokens[i : i + size] for i in range(0, len(tokens), size)]
            pieces += cut
            owners += [number] * len(cut)
            parts += range(len(cut))
        places = best_fit([len(p) for p in pieces], size)
        rows = 1 + max((r for r, _ in places), default=-1)
        matrix = np.zeros((rows, size), dtype=self.kind)
        resets = np.zeros((rows, size), dtype=bool)
        for piece, (row, start) in zip(pieces, places):
            matrix[row, start : start + len(piece)] = piece
            resets[row, start] = True
        by_place = sorted(range(len(places)), key=lambda p: places[p])
        ends = np.cumsum([len(pieces[p]) for p in by_place], dtype=np.int64)
        name = f"pack-{uuid.uuid4().hex}"
        if rows:
            _write(self.folder, f"{name}.ids", matrix)
            _write(self.folder, f"{name}.cu_seqlens", np.concatenate([[0], ends]))
            _write(self.folder, f"{name}.resets", np.packbits(resets, axis=1))
        counts = np.bincount(owners, minlength=len(self.ids)) if owners else np.zeros(len(self.ids), int)
        none = [n for n in range(len(self.ids)) if not counts[n]]
        owners += none
        length = [len(p) for p in pieces] + [0] * len(none)
        columns = [
            [self.ids[n] for n in owners],
            [len(self.tokens[n]) for n in owners],
            [*parts, *[0] * len(none)],
            [int(counts[n]) for n in owners],
            [name] * len(pieces) + [None] * len(none),
            [r for r, _ in places] + [None] * len(none),
            [s for _, s in places] + [None] * len(none),
            length,
        ]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _SEGMENT_SCHEMA)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SEGMENT_SCHEMA)


def _packed(path: str, pattern: str, folder: str, capacity: int, group_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        kind = "<u2" if encoder.n_vocab <= 1 << 16 else "<u4"
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        group = _Group(folder, capacity, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part, "text")):
                    tokens = np.array(encoder.encode_ordinary(text), dtype=kind)
                    if group.held and group.held + len(tokens) > group_tokens:
                        yield group.packed()
                        group = _Group(folder, capacity, kind)
                    group.add(doc_id, tokens)
        if group.ids:
            yield group.packed()

    return pack


def pack_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    folder: str | None = None,
    row_tokens: int = ROW_TOKENS,
    group_tokens: int = GROUP_TOKENS,
) -> tuple[DataFrame, str]:
    """Writes the packed ids of all texts; returns the table of segments and the folder of files.

    ``path`` is a rank file and ``pattern`` its cutting pattern. A segment is a document's ``part`` (of ``parts``) at
    ``start`` of ``row`` in ``file``; the rest of a row is 0. For a file NAME the folder has NAME.ids.npy, NAME.cu_seqlens.npy (ends of the
    segments in order of row and start, after a 0) and NAME.resets.npy (bits). A null or empty text has no tokens:
    one segment of length 0 without a file. Special strings are ordinary text. Every row is a document, also if
    its doc_id is null or repeats. Other columns play no part. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "packed")
    segments = docs.select("doc_id", "text").mapInArrow(
        _packed(path, pattern, folder, row_tokens, group_tokens), SEGMENTS
    )
    return saved(segments, scratch_path(spark, "packed-segments")), folder


def _unpacked(folder: str):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, matrix, resets = None, None, None
        for batch in batches:
            rows = batch.select(["file", "row", "start", "length"]).to_pylist()
            ids, reset = [], []
            for r in rows:
                if r["file"] is None:
                    ids.append(b"")
                    reset.append(True)
                    continue
                if r["file"] != name:
                    name = r["file"]
                    matrix = _read(folder, f"{name}.ids")
                    resets = _read(folder, f"{name}.resets")
                end = r["start"] + r["length"]
                ids.append(matrix[r["row"], r["start"] : end].tobytes())
                bits = np.unpackbits(resets[r["row"]])[r["start"] : end]
                reset.append(bool(bits[0]) and not bits[1:].any())
            columns = {f: batch.column(f) for f in batch.schema.names}
            columns |= {"ids": pa.array(ids, pa.binary()), "one_reset": pa.array(reset)}
            yield pa.RecordBatch.from_pydict(columns)

    return unpack


def read_segments(segments: DataFrame, folder: str) -> DataFrame:
    """``segments`` with their ``ids`` as in the files, and whether they hold just one position reset.

    Segments are read in the order of the table, which has those of a file together.
    """
    return segments.mapInArrow(_unpacked(folder), f"{SEGMENTS}, ids binary, one_reset boolean")

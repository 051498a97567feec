"""Files that hold one JSON array of records, read in blocks.

Where a record begins depends on all bytes before: on whether they end inside a string and on how many brackets are
open. A task scans a block for each of the three states that it may begin in (outside a string, inside, behind a
backslash) and returns the state it ends in, the change of depth and the commas at the two lowest depths; chained, these give
every block its true state and the position of its first record. Blocks are then cut at the commas of depth one, which is one
of the two unless a file closes more brackets than it opens; such blocks are counted anew. A row is as small for a wrong state,
whose depth may drift with every record. A record that runs over the end of its block is read on by the block's task. A file
that is one block needs no scan: it begins outside. Each record is parsed once, by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.json_values import record_of, strict_json
from evalspark.operators.sampling import sample_n
from evalspark.sources.blocks import (
    BLOCK_BYTES,
    FIRST_BYTES,
    Block,
    File,
    chunks_of,
    list_files,
    on_blocks,
    onward,
    scanned,
)

OUTSIDE, INSIDE, ESCAPED = range(3)
_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = b'"\\,[]'
_STEPS = np.zeros(256, dtype=np.int8)
_STEPS[list(b"[{")] = 1
_STEPS[list(b"]}")] = -1
_STRUCTURE = np.zeros(256, dtype=bool)
_STRUCTURE[list(b"[]{},")] = True
_BLANK = b" \t\r\n\xef\xbb\xbf"
SCAN_SCHEMA = (
    "block bigint, first int, ends array<int>, changes array<bigint>, "
    "lows array<bigint>, commas array<bigint>, above array<bigint>"
)
COUNT_SCHEMA = "block bigint, commas bigint"
RECORD_SCHEMA = "file string, position bigint, record string"


def structure(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Brackets and commas outside strings: their places, bytes and the depth behind each, and the state at the end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    escaped = np.zeros(len(data) + 1, dtype=bool)
    slashes = np.flatnonzero(data == _BACKSLASH)
    if state == ESCAPED:
        escaped[0] = True
        slashes = slashes[slashes > 0]
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        lengths = np.diff(first, append=len(slashes))
        # a run of backslashes escapes what follows if it is odd
        escaped[(slashes[first] + lengths)[lengths % 2 == 1]] = True
    quotes = np.flatnonzero(data == _QUOTE)
    quotes = quotes[~escaped[quotes]]
    inside = int(state != OUTSIDE)
    places = np.flatnonzero(_STRUCTURE[data])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    found = data[places]
    end = (len(quotes) + inside) % 2
    if end and escaped[len(data)]:
        end = ESCAPED
    return places, found, np.cumsum(_STEPS[found], dtype=np.int64), end


def _scan(block: Block, number: int) -> Iterator[pa.RecordBatch]:
    ends, changes = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    # the lowest depth, the commas there and those one above
    lows, commas, above = [0, 0, 0], [0, 0, 0], [0, 0, 0]
    first = None
    for raw in chunks_of(block.file, block.start, None if block.file.compressed else block.end):
        if first is None and (text := raw.lstrip(_BLANK)):
            first = text[0]
        seen = {state: structure(raw, state) for state in set(ends)}
        for i, state in enumerate(ends):
            places, found, depth, end = seen[state]
            if len(depth):
                low = min(lows[i], changes[i] + int(depth.min()))
                if low < lows[i]:
                    commas[i], above[i] = 0, commas[i] if low == lows[i] - 1 else 0
                    lows[i] = low
                at = depth[found == _COMMA] + changes[i]
                commas[i] += int(np.count_nonzero(at == low))
                above[i] += int(np.count_nonzero(at == low + 1))
                changes[i] += int(depth[-1])
            ends[i] = end
    yield pa.RecordBatch.from_pylist(
        [
            {
                "block": number,
                "first": first,
                "ends": ends,
                "changes": changes,
                "lows": lows,
                "commas": commas,
                "above": above,
            }
        ],
        pa.schema(
            [
                ("block", pa.int64()),
                ("first", pa.int32()),
                ("ends", pa.list_(pa.int32())),
                ("changes", pa.list_(pa.int64())),
                ("lows", pa.list_(pa.int64())),
                ("commas", pa.list_(pa.int64())),
                ("above", pa.list_(pa.int64())),
            ]
        ),
    )


def _counted(item: tuple[Block, int, int], number: int) -> Iterator[pa.RecordBatch]:
    """The commas of depth one in a block whose state and depth are known."""
    block, state, depth = item
    n = 0
    for raw in chunks_of(block.file, block.start, None if block.file.compressed else block.end):
        places, found, depths, state = structure(raw, state)
        n += int(np.count_nonzero((found == _COMMA) & (depths + depth == 1)))
        depth += int(depths[-1]) if len(depths) else 0
    yield pa.RecordBatch.from_pydict({"block": [number], "commas": [n]})


def _separators(row: dict, state: int, depth: int) -> int | None:
    """How many commas of depth one a block has, None if its scan doesn't tell: then its depth falls below zero."""
    if "counted" in row:
        return row["counted"]
    height = 1 - depth - row["lows"][state]
    if height > 1:
        return None
    return 0 if height < 0 else row["above" if height else "commas"][state]


def _chained(rows: Sequence[dict]) -> tuple[list[tuple[int, int, int]], int]:
    """State, depth and number of records begun before each block, and how many commas part records in all.

    Commas that a scan doesn't tell are none.
    """
    state, depth, before = OUTSIDE, 0, 0
    out = []
    for row in rows:
        out.append((state, depth, before))
        before += _separators(row, state, depth) or 0
        depth += row["changes"][state]
        state = row["ends"][state]
    return out, before


def _count_rest(spark: SparkSession, sources: Sequence[Sequence[tuple[Block, dict]]]) -> None:
    """Counts the commas that the scans of arrays don't tell; such blocks' rows get ``counted``."""
    rest: list[tuple[Block, int, int]] = []
    rows: list[dict] = []
    for found in sources:
        scans = [row for _, row in found]
        if not _is_array(scans):
            continue
        for (block, row), (state, depth, _) in zip(found, _chained(scans)[0]):
            if _separators(row, state, depth) is None:
                rest.append((block, state, depth))
                rows.append(row)
    if rest:
        for counted in on_blocks(spark, rest, _counted, COUNT_SCHEMA).collect():
            rows[counted["block"]]["counted"] = counted["commas"]


def _is_array(rows: Sequence[dict]) -> bool:
    """Whether a file's first byte that isn't blank opens an array; another file is one record."""
    first = next((row["first"] for row in rows if row["first"] is not None), _OPEN)
    return first == _OPEN


def _emitted(file: str, records: list[tuple[int, bytes]]) -> pa.RecordBatch:
    kept = [(p, r) for p, r in ((p, r.strip(_BLANK)) for p, r in records) if r]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * len(kept), pa.string()),
            pa.array([p for p, _ in kept], pa.int64()),
            pa.array([r.decode("utf-8", "replace") for _, r in kept], pa.string()),
        ],
        names=["file", "position", "record"],
    )


def _records(item: tuple, number: int) -> Iterator[pa.RecordBatch]:
    """The records that begin in a block; ``limit`` ends them early. Without a state it is its file's first block."""
    block, state, depth, before, limit = item
    at = 0 if block.file.compressed else block.start
    end = block.file.length + 1 if block.file.compressed else block.end
    chunks = onward(block, at)
    if state is None:
        lead = []
        for raw in chunks:
            lead.append(raw)
            if raw.strip(_BLANK):
                break
        chunks = chain(lead, chunks)
        state = OUTSIDE
        if lead and (text := lead[-1].lstrip(_BLANK)) and text[0] != _OPEN:  # not an array
            yield _emitted(block.file.name, [(0, b"".join(chunks))])
            return
    held: list[bytes] | None = None  # the record that has begun, in pieces
    position = before
    for raw in chunks:
        places, found, depths, next_state = structure(raw, state)
        absolute = depths + depth
        cuts = ((found == _COMMA) & (absolute == 1)) | ((found == _OPEN) & (absolute == 1) & _from(absolute, depth, 0))
        cuts |= (found == _CLOSE) & (absolute == 0)
        out: list[tuple[int, bytes]] = []
        last, finished = 0, False
        for place, byte in zip(places[cuts].tolist(), found[cuts].tolist()):
            if held is not None:
                held.append(raw[last:place])
                out.append((position, b"".join(held)))
                held = None
            last = place + 1
            if byte == _COMMA:
                position += 1
            if not block.file.compressed and at + place >= end:
                finished = True
                break
            if byte != _CLOSE:
                if limit is not None and position >= limit:
                    finished = True
                    break
                held = []
        yield _emitted(block.file.name, out)
        if held is not None:
            held.append(raw[last:])
        depth += int(depths[-1]) if len(depths) else 0
        state, at = next_state, at + len(raw)
        if finished or (held is None and not block.file.compressed and at >= end):
            return
    if held is not None:  # the file ends within a record
        yield _emitted(block.file.name, [(position, b"".join(held))])


def _from(depths: np.ndarray, start: int, value: int) -> np.ndarray:
    """Where the depth before a byte was ``value``."""
    return np.concatenate([[start], depths[:-1]]) == value


def record_texts(
    spark: SparkSession, path: str, num_records: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``file, position, record``: the text of every record of each array, or of the first ``num_records``.

    A block is a task, so one file is read by many. Blank files and empty arrays have no record; a file that holds no array
    is one record. Compressed files can't be cut and are one block each. With ``num_records`` the files are scanned only
    as far as needed. A file that ends early gives what it has.
    """
    limited = num_records is not None
    if limited and num_records == 0:
        return spark.createDataFrame([], RECORD_SCHEMA)
    single = min(block_bytes, FIRST_BYTES) if limited else block_bytes
    work: list[tuple] = []
    sources: list[list[File]] = []
    for file in list_files(spark, path):
        if not file.length:
            continue
        if file.compressed or file.length <= single:
            work.append((Block(0, file, 0, file.length), None, 0, 0, num_records))
        else:
            sources.append([file])

    def enough(rows: list[dict]) -> bool:
        return not _is_array(rows) or _chained(rows)[1] >= num_records

    scans = scanned(spark, sources, _scan, SCAN_SCHEMA, enough if limited else None, block_bytes)
    _count_rest(spark, scans)
    for found in scans:
        rows = [row for _, row in found]
        if not _is_array(rows):
            work.append((found[0][0], None, 0, 0, num_records))
            continue
        for (block, _), (state, depth, before) in zip(found, _chained(rows)[0]):
            if not limited or before < num_records:
                work.append((block, state, depth, before, num_records))
    return on_blocks(spark, work, _records, RECORD_SCHEMA)


def inferred_schema(records: DataFrame, column: str = "record") -> str | None:
    """Type of all records as a struct: numbers with a fraction are double, fields of several kinds strings."""
    found = records.agg(F.schema_of_variant_agg(record_of(F.col(column))).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        return None
    ddl = re.sub(r"DECIMAL\(\d+,\s*[1-9]\d*\)|FLOAT", "DOUBLE", found)
    ddl = re.sub(r"\b(VOID|VARIANT)\b", "STRING", ddl)
    return re.sub(r"\bOBJECT<", "STRUCT<", ddl)


def read_json_array(
    spark: SparkSession,
    path: str,
    num_samples: int | None = None,
    schema: str | None = None,
    missing_ok: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Records of each array with ``file`` and ``position``; first n of each file on request.

    ``num_samples`` of None or below 0 keeps all rows. Without ``schema`` a first pass over the records finds it. A path
    that doesn't exist is empty, with the columns of ``schema``, unless ``missing_ok`` is false. Records that can't be parsed have
    null fields.
    """
    limit = None if num_samples is None or num_samples < 0 else num_samples
    if not missing_ok and not list_files(spark, path):
        raise FileNotFoundError(path)
    texts = record_texts(spark, path, limit, block_bytes)
    ddl = schema or inferred_schema(texts)
    if ddl is None:
        return texts.select("file", "position")
    return texts.select(F.from_json(strict_json(F.col("record")), ddl).alias("_r"), "file", "position").select("_r.*", "file", "position")


def sample_json_array(
    spark: SparkSession,
    path: str,
    num_samples: int,
    seed: int = 0,
    schema: str | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Seeded sample without replacement; every row when n exceeds the size or is negative.

    ``keys`` names fields that identify a record. By default rows are drawn by the file's path below ``path`` and the
    position, so the same files in another folder give the same sample.
    """
    rows = read_json_array(spark, path, schema=schema)
    if num_samples < 0:
        return rows
    if keys is not None:
        return sample_n(rows, keys, num_samples, seed)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    tail = F.substring_index("file", f"/{root}/", -1)
    return sample_n(rows.withColumn("_name", tail), ["_name", "position"], num_samples, seed).drop("_name")

"""The first lines of line files, without reading the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evalspark.sources.blocks import BLOCK_BYTES, Block, File, chunks_of, on_blocks, scanned

COUNT_SCHEMA = "block bigint, n_lines bigint, n_records bigint"
LINE_SCHEMA = "file string, line_idx bigint, rec_idx bigint, value string"
ROWS = 10_000


def lines_of(block: Block) -> Iterator[bytes]:
    """The lines that begin in a block, without their ends; the last one is read on behind the block.

    Lines end with ``\\n``, ``\\r\\n`` or ``\\r``, as Spark's text reader has it.
    """
    whole = block.file.compressed
    at = 0 if whole else max(0, block.start - 1)
    end = None if whole else block.end
    # what comes first belongs to the line of the byte before the block
    skip = at < block.start and not whole
    held = b""
    for raw in chunks_of(block.file, at):
        pieces = (held + raw).splitlines(keepends=True)
        # the last piece may go on, also if its end may be half of one
        held = pieces.pop() if pieces else b""
        for piece in pieces:
            if end is not None and at >= end:
                return
            if skip:
                skip = False
            else:
                yield piece.rstrip(b"\r\n")
            at += len(piece)
    if held and not skip and (end is None or at < end):
        yield held.rstrip(b"\r\n")


def _counted(block: Block, number: int) -> Iterator[pa.RecordBatch]:
    lines = records = 0
    for line in lines_of(block):
        lines += 1
        records += bool(line.decode("utf-8", "replace").strip())
    yield pa.RecordBatch.from_pydict({"block": [number], "n_lines": [lines], "n_records": [records]})


def _numbered(item: tuple[Block, int, int, int], number: int) -> Iterator[pa.RecordBatch]:
    block, line, record, limit = item
    rows: list[tuple[int, int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block.file.name] * len(rows), pa.string()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.string()),
            ],
            names=["file", "line_idx", "rec_idx", "value"],
        )

    for raw in lines_of(block):
        if line >= limit:
            break
        if text := raw.decode("utf-8", "replace").strip():
            rows.append((line, record, text))
            record += 1
        line += 1
        if len(rows) >= ROWS:
            yield batch()
            rows = []
    yield batch()


def first_lines(
    spark: SparkSession, files: Sequence[File], source_pattern: str, limit: int, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Records within the first ``limit`` physical lines of each source, numbered as in the whole source.

    ``source_pattern`` finds the source in a file's name. Each source is scanned in doubling prefixes until it has
    ``limit`` lines; then only those blocks are read.
    """
    by_source: dict[str, list[File]] = {}
    for file in files:
        found = re.match(source_pattern, file.name)
        by_source.setdefault(found.group(1) if found else file.name, []).append(file)

    def enough(rows: list[dict]) -> bool:
        return sum(r["n_lines"] for r in rows) >= limit

    work = []
    for found in scanned(spark, list(by_source.values()), _counted, COUNT_SCHEMA, enough, block_bytes):
        line = record = 0
        for block, row in found:
            if line < limit and row["n_lines"]:
                work.append((block, line, record, limit))
            line += row["n_lines"]
            record += row["n_records"]
    return on_blocks(spark, work, _numbered, LINE_SCHEMA)

"""Files in byte blocks: what a block holds is found by tasks, where it stands by adding up blocks.

A *source* is a list of files that are numbered through, such as one file, or the part files of a folder. A task scans
a block and returns a few numbers; the driver, which knows the files' sizes, chains those of a source, a row for
each block. With a limit, sources are scanned from their start in prefixes that double until the limit is met, so the
rest of a large file is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import evalspark

# functions of this package travel to the workers whole, so it need not be installed there
cloudpickle.register_pickle_by_value(evalspark)

BLOCK_BYTES = 64 << 20
# a task reads so much at a time
CHUNK_BYTES = 8 << 20
# with a limit, so much of each source is scanned first
FIRST_BYTES = 64 << 10
# opening a file costs as much as reading so many bytes
OPEN_BYTES = 64 << 10
# many small blocks are dealt to so many tasks for each core
TASKS_PER_CORE = 4
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


@dataclass(frozen=True, order=True)
class File:
    """A file: its name as Spark's ``_metadata.file_path`` has it, the path that tasks open, bytes and time of change."""

    name: str
    path: str
    length: int
    changed: int

    @property
    def compressed(self) -> bool:
        return self.name.endswith(COMPRESSED)


@dataclass(frozen=True)
class Block:
    """Bytes ``start`` to ``end`` of a file of a source."""

    source: int
    file: File
    start: int
    end: int


def list_files(spark: SparkSession, path: str) -> list[File]:
    """Files that a path or pattern names, folders opened, in name order; hidden ones are left out."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[File] = []

    def add(status) -> None:
        name = status.getPath().getName()
        if status.isDirectory():
            for inner in files.listStatus(status.getPath()):
                if not inner.getPath().getName().startswith(("_", ".")):
                    add(inner)
        else:
            uri = status.getPath().toUri()
            scheme, place = uri.getScheme(), uri.getPath()
            host = uri.getRawAuthority()
            shown = f"{scheme}:{'//' + host if host else ''}{uri.getRawPath()}"
            opened = place if scheme == "file" else f"{scheme}://{host or ''}{place}"
            found.append(File(shown, opened, status.getLen(), status.getModificationTime()))

    for status in files.globStatus(pattern) or []:
        add(status)
    return sorted(found, key=lambda f: f.name)


def open_file(file: File) -> pa.NativeFile:
    """The file as a task reads it; compressed ones only from the start."""
    system, path = fs.FileSystem.from_uri(file.path) if "://" in file.path else (fs.LocalFileSystem(), file.path)
    return system.open_input_stream(path) if file.compressed else system.open_input_file(path)


def chunks_of(file: File, start: int, end: int | None = None) -> Iterator[bytes]:
    """The bytes of a file from ``start`` to ``end`` or its end, in chunks."""
    with open_file(file) as opened:
        if start:
            opened.seek(start)
        left = end - start if end is not None else None
        while left is None or left > 0:
            raw = opened.read(CHUNK_BYTES if left is None else min(CHUNK_BYTES, left))
            if not raw:
                return
            left = None if left is None else left - len(raw)
            yield raw


def source_blocks(source: int, files: Sequence[File], block_bytes: int) -> list[Block]:
    """A source's files in blocks; a compressed file is one."""
    out = []
    for file in files:
        step = max(file.length, 1) if file.compressed else block_bytes
        out += [Block(source, file, at, min(at + step, file.length)) for at in range(0, file.length, step)]
    return out


def onward(block: Block, start: int) -> Iterator[bytes]:
    """The bytes of a block from ``start``, then those behind it in steps that double: little is read for a short rest.

    A compressed file is read from its start to its end.
    """
    if block.file.compressed:
        yield from chunks_of(block.file, 0)
        return
    yield from chunks_of(block.file, start, block.end)
    at, step = block.end, FIRST_BYTES
    while at < block.file.length:
        for raw in chunks_of(block.file, at, at + step):
            at += len(raw)
            yield raw
        step = min(2 * step, BLOCK_BYTES)


def _packs(spark: SparkSession, items: Sequence) -> list[list[tuple[int, object]]]:
    """Items with their numbers, in order, as tasks take them: large blocks alone, small ones together.

    The number of tasks follows the bytes, not the number of files.
    """
    blocks = [item if isinstance(item, Block) else item[0] for item in items]
    costs = [block.end - block.start + OPEN_BYTES for block in blocks]
    total = sum(costs)
    tasks = max(-(-total // (BLOCK_BYTES + OPEN_BYTES)), min(len(items), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    packs: dict[int, list[tuple[int, object]]] = {}
    before = 0
    for number, (item, cost) in enumerate(zip(items, costs)):
        packs.setdefault(before * tasks // total, []).append((number, item))
        before += cost
    return list(packs.values())


def on_blocks(
    spark: SparkSession, blocks: Sequence, work: Callable[..., Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """The rows that ``work`` makes of each block; a task gets one large block, or several small ones, and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column("pack").to_pylist():
                for number, item in cloudpickle.loads(pack):
                    yield from work(item, number)

    held = list(blocks)
    if not held:
        return spark.createDataFrame([], schema)
    rows = [(cloudpickle.dumps(pack),) for pack in _packs(spark, held)]
    packs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "pack binary", verifySchema=False)
    return packs.mapInArrow(run, schema)


def scanned(
    spark: SparkSession,
    sources: Sequence[Sequence[File]],
    work: Callable,
    schema: str,
    enough: Callable[[list[dict]], bool] | None,
    block_bytes: int = BLOCK_BYTES,
) -> list[list[tuple[Block, dict]]]:
    """For each source its blocks with the row that ``work`` found in each, as far as they were scanned.

    ``enough`` tells from the rows of a source so far whether the rest is needed. Without it all blocks are scanned in one
    job; with it each job scans twice as much of every unfinished source as was scanned before. The first blocks are
    small then: a block boundary costs nothing but a row.
    """
    done: list[list[tuple[Block, dict]]] = [[] for _ in sources]
    if enough is None:
        waves = [[source_blocks(i, files, block_bytes) for i, files in enumerate(sources)]]
        open_sources = set()
    else:
        waves = []
        rest = {i: _growing(i, files, block_bytes) for i, files in enumerate(sources)}
        open_sources = set(rest)
    while waves or open_sources:
        if enough is not None:
            waves = [[next(rest[i], []) for i in sorted(open_sources)]]
        blocks = [block for source in waves.pop() for block in source]
        if not blocks:
            break
        rows = sorted(on_blocks(spark, blocks, work, schema).collect(), key=lambda r: r["block"])
        for block, row in zip(blocks, rows):
            done[block.source].append((block, row.asDict()))
        open_sources = {i for i in open_sources if not enough([row for _, row in done[i]])}
    return done


def _growing(source: int, files: Sequence[File], block_bytes: int) -> Iterator[list[Block]]:
    """A source's blocks in waves, each as long as all before it."""
    wave: list[Block] = []
    room, passed = FIRST_BYTES, 0
    for file in files:
        at = 0
        while at < file.length:
            step = file.length if file.compressed else min(block_bytes, room, file.length - at)
            wave.append(Block(source, file, at, at + step))
            at, room, passed = at + step, room - step, passed + step
            if room <= 0:
                yield wave
                wave, room = [], passed
    if wave:
        yield wave

"""Web archives: records compressed one by one with a Zstandard dictionary kept in the file.

Every task writes its pages to archive files of its own in the shared folder and returns a row per
file; only files named in that manifest count, so what a lost or repeated task left behind is never
read. An archive begins with a skippable frame that holds the dictionary, built from the archive's own first
records; each record is a Zstandard frame, so a record can be read at its offset without the others.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import filesystem, saved, slices
from evalspark.session import scratch_path

# Fixed values of the format: frame mark of a dictionary, profile of a revisit by equal payload.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_URN = "urn:page:"
# the exact url where its field can't hold it: control characters, blanks at the ends
EXACT_URL = "Page-URL"
CONTROL = re.compile("[\x00-\x1f\x7f]")
REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
DICTIONARY_BYTES = 32 << 10
# the dictionary is fitted to at most so much of an archive's first records, so much of each
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD_BYTES = 64 << 10

MANIFEST = "path string, records long, bytes long"
PAGES = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def marked_pages(pages: DataFrame) -> DataFrame:
    """Pages with payload, its digest and length, and the page they repeat (``refers_to``)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        "payload_bytes",
        F.when(
            ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")
        ).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<{RECORD_URN}{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(RECORD_URN)
    return int(number) if number else None


def record_bytes(row: dict, date: str) -> bytes:
    """The record of a page: a response with the payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + row["payload"]
    url = row["url"]
    # as it is, so that any reader can use it; null has no such field
    target = [] if url is None else [f"WARC-Target-URI: {CONTROL.sub(lambda c: quote(c[0]), url).strip()}"]
    if url is not None and (CONTROL.search(url) or url != url.strip()):
        target.append(f"{EXACT_URL}: {quote(url, safe='')}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {date}",
        *target,
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_of_record(raw: bytes) -> dict:
    """The page of a record; fails if a response's payload doesn't have the digest it states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": unquote(fields[EXACT_URL]) if EXACT_URL in fields else url,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _page_of(fields["WARC-Refers-To"]),
        "payload_bytes": len(payload) if response else int(stated["Content-Length"]),
        "payload_digest": digest,
        "payload": payload if response else None,
    }


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary of the samples, or None where they are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, ValueError):
        return None


class _Archive:
    """A file being written: records wait until there are enough to build the dictionary."""

    def __init__(self, folder: str):
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{folder}/{self.name}"
        self.out = files.open_output_stream(f"{root}/{self.name}", compression=None)
        self.waiting: list[bytes] | None = []
        self.held = self.records = self.size = 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def _put(self, frame: bytes) -> None:
        self.out.write(frame)
        self.size += len(frame)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        waiting, self.waiting = self.waiting, None
        dictionary = trained_dictionary([r[:SAMPLE_RECORD_BYTES] for r in waiting])
        if dictionary is not None:
            content = dictionary.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        for record in waiting:
            self._put(self.compressor.compress(record))

    def close(self) -> dict:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.size}


def _write(folder: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for part in slices(batch, "payload"):
                for row in part.to_pylist():
                    archive = archive or _Archive(folder)
                    archive.add(record_bytes(row, date))
                    if archive.size >= archive_bytes:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return write


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed frames of an archive, one after the other."""
    data = stream.read(chunk)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        end = 8 + struct.unpack("<I", data[4:8])[0]
        while len(data) < end:
            data += stream.read(chunk)
        dictionary = zstandard.ZstdCompressionDict(data[8:end])
        data = data[end:]
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(chunk)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                break
            if not (data := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
        data = frame.unused_data
        yield b"".join(parts)


def _read(payloads: bool):
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, root = filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(root, compression=None) as stream:
                    for raw in frames(stream):
                        page = page_of_record(raw)
                        if not payloads:
                            page["payload"] = None
                        rows.append(page)
                        held += len(page["payload"] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    date: str = "2000-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the manifest of files.

    The payload is the html in UTF-8, null as the empty payload. Of the rows with equal payloads of at
    least 100 bytes, that with the smallest page_id is a response and the others are revisits that
    refer to it; shorter payloads are all responses. Rows that repeat the smallest page_id are responses
    too; a null page_id is larger than any other. A null url is written as about:blank. Other columns
    aren't archived. No rows make no file.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    manifest = marked_pages(pages).mapInArrow(_write(folder, date, archive_bytes), MANIFEST)
    return saved(manifest, scratch_path(spark, "archive-manifest"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages in the files of a manifest; the payload of a revisit is null.

    Digest and length are those of the full payload: of a response as read, of a revisit as
    its record states them. A file is read by one task.
    """
    files = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(files, "path").mapInArrow(_read(payloads), PAGES)

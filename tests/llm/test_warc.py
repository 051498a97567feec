import hashlib
import struct

import zstandard
from pyspark.sql import types as T

from evalspark.llm import warc

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


def edge_pages():
    page = "<html>" + "body é " * 40
    rows = [(9, "http://a/\r\nX: y", page), (3, None, page), (None, "u", page), (3, None, page)]
    rows += [(1, "http://s", "short"), (2, "http://s", "short"), (5, "n", None), (6, "e", "")]
    rows += [(7, "long", "x" * 3_000_000), (None, "z", "w" * 100), (None, "z", "w" * 100)]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i}</p>" + "common markup " * 20) for i in range(300)]
    return [(*r, "own") for r in rows]


def brute(rows):
    out = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        ids = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == raw]
        first = min(ids, default=None)
        revisit = len(raw) >= 100 and first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = edge_pages()
    pages = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_archives(pages, archive_bytes=50_000)
    read = warc.read_archives(manifest)
    got = [tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(rows)
    texts = {(r["page_id"], r["payload"].decode()) for r in read.collect() if r["record_type"] == "response"}
    assert texts <= {(r[0], r[2] or "") for r in rows}
    assert {r["url"] for r in read.collect()} == {r[1] for r in rows}
    assert sum(r["records"] for r in manifest.collect()) == len(rows)


def test_dictionary_leads_the_file(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><head><title>{i}</title></head>" + "shared markup " * 30, "") for i in range(2000)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path))
    (path,) = [r["path"] for r in manifest.collect()]
    with open(path, "rb") as file:
        data = file.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    record = frame.decompress(data[8 + size :])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response")
    # one record a frame, and the dictionary pays
    assert record.count(b"WARC/1.1") == 1
    assert len(data) < 2000 * len(zstandard.compress(record))


def test_empty_table(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0
    assert warc.read_archives(manifest).count() == 0


def test_changed_payload_fails():
    row = {"page_id": 1, "url": "u", "refers_to": None, "payload": b"abc", "payload_bytes": 3, "payload_digest": "0"}
    try:
        warc.page_of_record(warc.record_bytes(row, "2000-01-01T00:00:00Z"))
    except ValueError:
        return
    raise AssertionError


def test_target_uri_is_readable_by_others():
    def record(url):
        row = {"page_id": 1, "url": url, "payload": b"x", "payload_bytes": 1, "payload_digest": hashlib.sha256(b"x").hexdigest(), "refers_to": None}
        return warc.record_bytes(row, "2024-01-01T00:00:00Z")

    url = "https://example.org/a?b=c%20d&é=1"
    raw = record(url)
    assert f"\r\nWARC-Target-URI: {url}\r\n".encode() in raw
    for exact in (url, "", " x", "a\r\nb: c", "%0D", "\x00\x7f", "a: b", None):
        raw = record(exact)
        assert warc.page_of_record(raw)["url"] == exact
        head = raw.split(b"\r\n\r\n")[0]
        assert (b"WARC-Target-URI" in head) == (exact is not None) and head.count(b"\r\n") <= 9

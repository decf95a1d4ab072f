import hashlib
import struct

import pytest
import zstandard

from merchlens.llm import warc
from merchlens.session import scratch_path


def test_round_trip_and_revisits(spark):
    long = "<p>" + "é" * 700
    rows = [
        (1, "http://a/b c?x=%20&y=é", long, "x"),
        (5, "http://b", long, "x"),
        (3, None, long, "x"),
        (2, "http://c", "short", "x"),
        (4, "http://d", "short", "x"),
        (6, "http://e\r\nX: y", None, None),
        (7, "http://f", "", "x"),
        (None, "http://g", "n" * 1200, "x"),
        (8, "http://h", "z" * 3_000_000, "x"),
        (9, "http://i", "twin" * 400, "x"),
        (9, "http://i", "twin" * 400, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    want = {(i, u, (h or "").encode()) for i, u, h, _ in rows}
    newest = {1: 5, 3: 5}
    assert len(got) == len(rows)
    for r in got:
        raw = next(h for i, u, h in want if (i, u) == (r["page_id"], r["url"]))
        assert r["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["payload_bytes"] == len(raw)
        assert r["refers_to"] == newest.get(r["page_id"])
        assert r["record_type"] == ("revisit" if r["page_id"] in newest else "response")
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages).count() == 0


def test_archive_layout_and_damage():
    records = [warc.record(i, "http://x", b"p" * i, i, hashlib.sha1(b"p" * i).hexdigest()) for i in range(50)]
    dictionary = warc.train(records)
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    raw = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(compressor.compress(r) for r in records)
    assert list(warc.frames(memoryview(raw), chunk=7)) == records
    assert warc.parse(records[3])[0] == 3
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(raw[8:])))
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(raw[:-3])))
    with pytest.raises(ValueError):
        warc.parse(records[9].replace(b"ppp", b"pqp"))

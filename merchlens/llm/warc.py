"""Web archives: a dictionary-compressed WARC writer and its reader.

A Zstandard dictionary is trained on a bounded sample of archived records and stands in a leading skippable frame of
every archive; each record is a Zstandard frame of its own, so an archive can be read from any record on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written

REVISIT_BYTES = 1000
SAMPLE_RECORDS = 512
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id, url, payload: bytes, length: int, sha1_hex: str, refers_to=None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header (with the full length) but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse(raw: bytes) -> tuple:
    """A record's page id, url, payload length, digest, type, referred page and payload; raises where they disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest or length")
    number = lambda field: None if field is None or field.endswith("none>") else int(field.rpartition(":")[2].rstrip(">"))
    url = fields.get("WARC-Target-URI")
    return (
        number(fields["WARC-Record-ID"]),
        None if url is None else urllib.parse.unquote(url),
        length,
        digest,
        kind,
        number(fields.get("WARC-Refers-To")),
        payload if kind == "response" else None,
    )


def train(samples: list[bytes]) -> bytes:
    """Dictionary from sample records; too few or too short ones are used as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" ")


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


class _Archive:
    """Open archive; a new one begins with the dictionary in a skippable frame."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str, dictionary: bytes):
        self.name, self.records, self.bytes = name, 0, 0
        self.out = files.open_output_stream(f"{folder}/{name}", compression=None)
        self.put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def put(self, frame: bytes) -> None:
        self.out.write(frame)
        self.bytes += len(frame)


def _writer(folder: str, dictionary: bytes):
    def write(batches):
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        part, archive, done = TaskContext.get().partitionId(), None, []

        def close():
            archive.out.close()
            done.append((archive.name, archive.records, archive.bytes))

        for batch in batches:
            ids, urls, htmls, sizes, digests, refers = (batch.column(c) for c in ("page_id", "url", "html", "size", "digest", "refers_to"))
            for i in range(batch.num_rows):
                # names are unique to an attempt: what a lost attempt left is not in the manifest
                if archive is None:
                    archive = _Archive(files, path, f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.warc.zst", dictionary)
                html = htmls[i].as_py() or b""
                archive.put(compressor.compress(record(ids[i].as_py(), urls[i].as_py(), html, sizes[i].as_py(), digests[i].as_py(), refers[i].as_py())))
                archive.records += 1
                if archive.bytes >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            names, records, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"file": list(names), "records": list(records), "bytes": list(sizes)})

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page below ``folder``; returns the manifest (file, records, bytes) of committed archives.

    Payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least 1000 bytes, that with the
    largest page_id is the response (null ids are smallest; repeated rows of that id are responses too), the others
    revisit it. Other columns are not read. An empty table gives no archive.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    newest = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("newest"))
    rows = rows.join(newest, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("newest")))
    rows = rows.withColumn("html", F.when(~revisit, F.col("html"))).drop("newest")
    pick = F.xxhash64("page_id", "url")
    last = pages.select(pick.alias("h")).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    chosen = pages.filter(pick <= F.lit(last)).limit(SAMPLE_RECORDS)
    sample = chosen.select("page_id", "url", F.substring(html, 1, SAMPLE_BYTES).alias("html")).collect()
    samples = [record(r["page_id"], r["url"], bytes(r["html"]), len(r["html"]), hashlib.sha1(r["html"]).hexdigest()) for r in sample]
    manifest = rows.mapInArrow(_writer(folder, train(samples)), "file string, records long, bytes long")
    return written(manifest, "warc-manifest")


def frames(raw: memoryview, chunk: int = 1 << 14):
    """Decompressed records of an archive, one after another; the dictionary is that of its leading frame."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("archive has no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(raw[8 : 8 + size])))
    at = 8 + size
    while at < len(raw):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            piece = raw[at : at + chunk]
            if not len(piece):
                raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def _reader(payloads: bool):
    def read(batches):
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)))
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in frames(memoryview(content.as_buffer())):
                    row = parse(raw)
                    rows.append(row if payloads else (*row[:-1], None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in the manifest; damaged records raise. Revisits carry the length and digest of the
    full payload but no payload."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    files = files.join(manifest.select("file"), "file", "left_semi").select("content")
    return files.mapInArrow(_reader(payloads), READ_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back, one row per record."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

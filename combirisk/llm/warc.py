"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with as many records as fit
``FRAME_BYTES``, and a seek table in a skippable frame at its end: compressed and
uncompressed size of every frame, their number, and a closing magic number.  Readers
without knowledge of it decompress the file as one stream; readers with it find any
frame from the last bytes.  The index maps every record to bundle, frame and offset in
the uncompressed frame.

Equal payloads of ``REVISIT_BYTES`` and more are kept once, in the record with the
smallest page_id; the others are revisits that name it.

Tasks write bundles under names of their own into the shared folder; only the bundles
of the attempts that succeed are in the index, so a lost executor leaves at most
files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import stored, table, utf8
from combirisk.session import work_path

REVISIT_BYTES = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
# Bytes of records that one task should read back.
READ_BYTES = 32 << 20
LEVEL = 3
# Fixed values of the seekable format and of the archive format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, bundle string, frame int, start int, size int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    body = HTTP_HEAD if kind == "revisit" else HTTP_HEAD + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url:
        # A line break in an address would end the header.
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Appends records to one bundle; ``add`` gives frame and offset, ``close`` writes the seek table."""

    def __init__(self, sink) -> None:
        self.sink = sink
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = 0
        self.written = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.flush()
        place = (len(self.sizes), self.filled)
        self.open.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.sink.write(frame)
            self.sizes.append((len(frame), self.filled))
            self.written += len(frame)
            self.open, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        sizes = np.frombuffer(source.read_at(8 * count, size - 9 - 8 * count), "<u4").reshape(count, 2).astype(np.int64)
        self.sizes = sizes
        self.starts = np.cumsum(sizes[:, 0]) - sizes[:, 0]

    def frame(self, number: int) -> bytes:
        packed = self.source.read_at(int(self.sizes[number, 0]), int(self.starts[number]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[number, 1]))


def classified(pages: DataFrame) -> DataFrame:
    """Add payload_digest, record_type and refers_to to every row of ``pages(page_id, url, html)``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("payload_digest"))
    large = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= REVISIT_BYTES
    # Only digests that occur again matter, and a copy group is one row here.
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(firsts, "payload_digest", "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages(page_id, url, html)`` as a record below ``folder``; returns the index.

    Null html is an empty payload and null addresses have no header.  Rows that
    share the smallest page_id of their payload are all responses.  Further columns
    are ignored; an empty table writes no bundle.  The folder must be shared.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        writer, name = None, ""
        for batch in batches:
            ids, urls, types, refers, digests = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "payload_digest"))
            out: list[tuple] = []
            for page_id, url, payload, kind, to, digest in zip(ids, urls, utf8(batch.column("html")), types, refers, digests):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                data = record(page_id, url, payload, digest, kind, to, date)
                out.append((page_id, name, *writer.add(data), len(data)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["page_id", "bundle", "frame", "start", "size"])
        if writer is not None:
            writer.close()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    # The index is what remembers the bundles of successful attempts, so it is written before anything reads it.
    return stored(classified(pages).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in ``index``, read from the bundles.

    Frames are dealt over tasks; each is opened through the seek table and
    decompressed once.  A payload that does not fit its digest is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, number, reader, frame = None, -1, None, b""
        for batch in batches:
            out: list[tuple] = []
            for page_id, bundle, place, start, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "bundle", "frame", "start", "size"))):
                if bundle != name:
                    reader, name, number = BundleReader(store.open_input_file(f"{base}/{bundle}")), bundle, -1
                if place != number:
                    frame, number = reader.frame(place), place
                fields, payload = parse_record(frame[start : start + size])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-record-id"] != f"<urn:page:{page_id}>":
                    raise ValueError(f"record {page_id} is not at its place")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {page_id} is damaged")
                to = fields.get("warc-refers-to")
                out.append((page_id, int(fields["warc-payload-length"]) if kind == "revisit" else len(payload), digest, kind, int(to[len("<urn:page:") : -1]) if to else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # The index is tiny beside what it points to: tasks are counted by the bytes they will read.
    parts = max(1, -(-(index.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // READ_BYTES))
    dealt = index.repartition(parts, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "start")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc_bundles(spark, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    return read_records(write_bundles(table(spark, sf_dir, "pages"), folder), folder)


OP3_SQL = f"""
with rows as (select page_id, coalesce(html, '') as payload from pages),
firsts as (select payload, min(page_id) as first from rows where strlen(payload) >= {REVISIT_BYTES} group by payload)
select page_id, strlen(r.payload) as payload_bytes, sha256(r.payload) as payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from rows r left join firsts f on r.payload = f.payload
"""

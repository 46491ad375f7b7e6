"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress independently; a skippable frame at a bundle's end lists the frames'
compressed and decompressed sizes (the public seekable format), so that a reader finds any frame from the footer alone.
An index table maps each record to its bundle, frame and place inside the frame. Equal payloads are stored once; the
other records revisit the one with the smallest id.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, text_chunks, written

#: Fixed values of the seekable format: the skippable frame's magic number, and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 262_144
BUNDLE_BYTES = 64_000_000
#: Payloads shorter than this are stored each time.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"

RECORDS = "source_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, bundle string, frame int, place int"
INDEX = "record_id string, source_id string, bundle string, frame int, place int, size int"


class BundleWriter:
    """Writes frames to a stream, then the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.buffer: list[bytes] = []
        self.size = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Appends a record; its frame and its place in there."""
        if self.buffer and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.buffer.append(record)
        self.size += len(record)
        self.total += len(record)
        return at

    def flush(self) -> None:
        """Ends the current frame."""
        if self.buffer:
            packed = self.compress(b"".join(self.buffer))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        """Ends the bundle with its seek table."""
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Reads the seek table from the end of a file, then any frame."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError("the bundle has no seek table")
        file.seek(size - 9 - 8 * n)
        raw = file.read(8 * n)
        self.frames, at = [], 0
        for packed, full in struct.iter_unpack("<II", raw):
            self.frames.append((at, packed, full))
            at += packed
        if at + 17 + 8 * n != size:
            raise ValueError("the seek table doesn't fit the bundle")

    def frame(self, k: int) -> bytes:
        """The records of frame ``k``."""
        at, packed, full = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=max(1, full))


def record_id(source_id: str | None, digest: str) -> str:
    """A record's identifier, the same wherever it is computed."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{source_id}:{digest}'.encode()).digest()[:16])}>"


def encode(source_id: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record; of a revisit only the payload's size counts. Characters that would break a header line are percent-encoded in the address."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(source_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if source_id is not None:
        head.append(f"X-Source-Id: {source_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Source-Id: {refers_to}")
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The header fields (names in lower case), the block, and the place after the record that begins at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    begin = end + 4
    stop = begin + int(fields["content-length"])
    return fields, raw[begin:stop], stop + 4


def _open(path: str, write: bool = False):
    """A stream on any store that pyarrow knows: driver and executors open the shared folder by its URI."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    if write:
        if store.type_name == "local":
            store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_file(inner)


#: Digests of shared payloads that a join broadcasts, at most (40 bytes each and some overhead); beyond, rows are shuffled.
BROADCAST_DIGESTS = 500_000


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(source_id, url, payload (null for revisits), size, digest, refers_to, revisit) of each row. Of equal payloads of LEAST_SHARED bytes or
    more the smallest id is the response; ids that are null are never that unless all are (then all are responses). A
    group's minimum is pre-aggregated from digests and ids alone, and written; only groups of several rows remain, which
    are counted: few go to the rows, else rows are shuffled to them, plainly on either side, so that Spark can split a
    payload that many rows have."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST_SHARED).select(F.unhex("digest").alias("key"), "id")
    shared = written(long.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "shared")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    few = shared.count() <= BROADCAST_DIGESTS
    return rows.join(F.broadcast(shared) if few else shared, F.unhex("digest") == F.col("key"), "left").select(
        F.col("id").cast("string").alias("source_id"), "url", F.when(~revisit, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("size"), "digest", F.when(revisit, F.col("first").cast("string")).alias("refers_to"), revisit.alias("revisit"),
    )


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes every row as a record and returns the index (columns INDEX), itself a table in the shared folder. A record's
    identifier is made of its id and digest, so rows that repeat both share one; bundle, frame and place tell them apart.

    Bundles lie in ``folder`` (a URI that all executors reach; by default in the shared folder). Each attempt of a task
    writes bundles of its own names, and only those of the attempt that succeeded enter the index."""
    folder = folder or scratch_path(pages.sparkSession, "bundles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, rows = None, "", []

        def finish() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("record_id", pa.string()), ("source_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("place", pa.int32()), ("size", pa.int32())]))

        for chunk in text_chunks(batches, 2):
            for source, url, payload, size, digest, refers_to, revisit in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                if out is None:
                    path, rows = f"{folder}/{uuid.uuid4().hex}.warc.zst", []
                    out = BundleWriter(_open(path, write=True))
                record = encode(source, url, (payload or "").encode(), size, digest, refers_to, revisit)
                frame, place = out.add(record)
                rows.append({"record_id": record_id(source, digest), "source_id": source, "bundle": path, "frame": frame, "place": place, "size": len(record)})
                if out.total >= bundle_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return written(planned(pages, id_col, url_col, payload_col).mapInArrow(run, INDEX), "index")


def read(bundles: DataFrame, column: str = "bundle", with_payload: bool = True) -> DataFrame:
    """All records (columns RECORDS) of the bundles that ``column`` names, each bundle once: frame by frame, found by
    the seek tables. Of responses, length and digest are computed from the payload as read; a payload that differs from
    its digest is an error."""
    names = written(bundles.select(F.col(column).alias("bundle")).where("bundle is not null").distinct(), "names")
    names = names.repartition(max(1, names.count()))  # a few bytes a row, but each stands for a whole bundle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("place", pa.int32())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    reader, rows, held = BundleReader(file), [], 0
                    for k in range(len(reader.frames)):
                        raw, at = reader.frame(k), 0
                        while at < len(raw):
                            place = at
                            fields, block, at = decode(raw, at)
                            row = {"source_id": fields.get("x-source-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "bundle": path, "frame": k, "place": place}
                            digest, size, payload = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), None
                            if row["record_type"] == "response":
                                payload = block[block.index(b"\r\n\r\n") + 4 :]
                                if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                    raise ValueError(f"a payload in {path}, frame {k}, doesn't have its digest")
                            rows.append(row | {"payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("x-refers-to-source-id"), "payload": payload if with_payload else None})
                            held += len(payload or b"") if with_payload else 200
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return names.mapInArrow(run, RECORDS)


def fetch(entry) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, given its row of the index: reads the footer and one frame."""
    with _open(entry["bundle"]) as file:
        fields, block, _ = decode(BundleReader(file).frame(entry["frame"]), entry["place"])
    return fields, block


def op6_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, then reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = read(write(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

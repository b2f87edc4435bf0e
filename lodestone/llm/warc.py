"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, and behind them a skippable frame with a seek table
in the public seekable format: for each frame its compressed and plain bytes (u32 each), then the number of frames, a descriptor
byte and the magic number. Any Zstandard reader can read a bundle from start to end. The record index maps each record to its
bundle, frame, offset in the plain frame and length, so that one record costs one read of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, bound_batches, cut, fresh, storage

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit carries the HTTP header of the full payload, and of the payload only its digest and length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_in(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields (names in lower case) and block of each record of a plain frame."""
    at = 0
    while at < len(plain):
        head_end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:head_end].decode("utf-8", "replace").split("\r\n")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        n = int(fields["content-length"])
        yield at, fields, plain[head_end + 4 : head_end + 4 + n]
        at = head_end + 4 + n + 4


def parsed(fields: dict[str, str], block: bytes) -> dict:
    """What a record says; a response's payload length and digest are taken anew from its payload."""
    number = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head)[1])
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != told):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": told,
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


class BundleWriter:
    """Groups records into frames of about frame_bytes; a longer record has a frame of its own. Holds one frame and the seek table."""

    def __init__(self, sink, frame_bytes: int):
        self.sink, self.frame_bytes, self.zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.parts: list[bytes] = []
        self.held, self.table = 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        if len(record) >= 1 << 32:
            raise ValueError("a record of 4 GB or more doesn't fit the seek table")
        if self.held and self.held + len(record) > self.frame_bytes:
            self._flush()
        place = (len(self.table), self.held, len(record))
        self.parts.append(record)
        self.held += len(record)
        return place

    def _flush(self) -> None:
        if self.held:
            stored = self.zstd.compress(b"".join(self.parts))
            self.sink.write(stored)
            self.table.append((len(stored), self.held))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Reads frames by the seek table."""

    def __init__(self, uri: str):
        fs, path = storage(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if descriptor & 128 else 8
        raw = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for i in range(n):
            stored, plain = struct.unpack_from("<II", raw, i * width)
            self.frames.append((at, stored, plain))
            at += stored

    def frame(self, i: int) -> bytes:
        at, stored, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(stored, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> dict:
        _, fields, block = next(records_in(self.frame(frame)[offset:]))
        return parsed(fields, block)

    def records(self) -> Iterator[dict]:
        for i in range(len(self.frames)):
            for _, fields, block in records_in(self.frame(i)):
                yield parsed(fields, block)

    def close(self) -> None:
        self.file.close()


def with_referrals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, most_broadcast: int = 200_000) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the smallest page_id with an equal payload where that is another page's.

    Only (digest, smallest id) of payloads that stand on more than one row meets the pages again. That table is written, its rows
    are counted, and up to `most_broadcast` of them are broadcast, so that no text is shuffled; beyond, Spark joins by shuffle and
    splits a payload on very many rows by the skew join. Payloads are equal if their SHA-256 are. Payloads under `least` bytes
    never refer. Null html is an empty payload; a null page_id refers to the smallest id of its group but is never referred to; if
    an id stands on several rows, all of them are responses or all revisits, and their records share the id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    large = F.octet_length("payload") >= least
    digest = F.unhex(F.sha2("payload", 256))
    keyed = rows.withColumn("digest", F.when(large, digest).otherwise(F.encode(F.xxhash64("page_id", "payload").cast("string"), "UTF-8")))  # shorter than any digest
    several = rows.where(large).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = cut(several, "warc-first")
    if first.count() <= most_broadcast:
        first = F.broadcast(first)
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return keyed.join(first, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


INDEX = "uri string, page_id long, frame int, offset long, length long"
_INDEX = pa.schema([("uri", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


def write_bundles(pages: DataFrame, out: str | None = None, frame_bytes: int = 1 << 18, date: str = "2024-01-01T00:00:00Z", least: int = 0, **columns) -> DataFrame:
    """Write a record for each page, one bundle a task; returns the record index (uri, page_id, frame, offset, length).

    A bundle's name holds the task attempt and only bundles of the index count. No rows: no bundle, an empty index.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    out = out or fresh(spark, "warc")

    def write(it):
        from pyspark import TaskContext

        task, bundle, rows = TaskContext.get(), None, []
        for batch in batches(it, "payload"):
            if bundle is None:
                uri = f"{out}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
                fs, path = storage(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                file = fs.open_output_stream(path, compression=None)
                bundle = BundleWriter(file, frame_bytes)
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = bundle.add(record_of(page_id, url, payload, digest_of(payload), refers_to, date))
                rows.append((uri, page_id, *place))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
            rows = []
        if bundle is not None:
            bundle.close()
            file.close()

    return cut(with_referrals(pages, least=least, **columns).mapInArrow(write, INDEX), "warc-index")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles, read from the files, one task a bundle; payloads of responses are checked on the way."""
    bundles = index.select("uri").distinct()

    def read(it):
        for batch in it:
            for uri in batch.column(0).to_pylist():
                reader, rows = BundleReader(uri), []
                for record in reader.records():
                    rows.append({k: record[k] for k in _RECORD.names})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows = []
                reader.close()
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, RECORD)


def lookup(index: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the asked pages only, each by one read of one frame."""
    places = index.join(ids.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi").select("uri", "frame", "offset")

    def read(it):
        at, reader = None, None
        for batch in it:
            rows = []
            for uri, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != at:
                    if reader:
                        reader.close()
                    at, reader = uri, BundleReader(uri)
                rows.append({k: v for k, v in reader.record(frame, offset).items() if k in _RECORD.names})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return places.repartition("uri").sortWithinPartitions("uri", "frame", "offset").mapInArrow(read, RECORD)

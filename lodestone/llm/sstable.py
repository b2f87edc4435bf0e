"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order:

    data block*   entries: varint shared, varint unshared, varint value bytes, key suffix, value;
                  every 16th key is whole (a restart), the block ends with the restarts' offsets (u32 each) and their number;
                  stored as zstd frame with the crc32 of the stored bytes behind it
    filter block  Bloom filter over the distinct keys: 10 bits a key, 7 probes by double hashing
    index block   sparse: for each data block its last key, offset and stored bytes
    footer        56 bytes: offsets and lengths of filter and index, entries, ids, bytes an id, magic

A key is one byte (0: null identifier, 1: other) and the identifier as big-endian 64-bit integer with its sign bit turned, so
byte order is numeric order with null first. A value is the document's ids as little-endian unsigned integers, 2 bytes each where
the vocabulary allows it, else 4.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import batches, bound_batches, cut, fresh, storage

MAGIC = 0x4C4F444553535431
RESTART = 16
FOOTER = struct.Struct("<QQQQQQQ")
BLOOM_PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; add() wants keys in ascending order, equal ones allowed. Holds one block, the sparse index and the keys."""

    def __init__(self, sink, width: int, block_bytes: int = 1 << 16):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.zstd = zstandard.ZstdCompressor(level=3)
        self._new()

    def _new(self) -> None:
        self.block, self.held, self.restarts, self.count, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.held)
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.held += len(entry)
        self.count += 1
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        self._block(self.last, self.zstd.compress(raw))
        self._new()

    def _block(self, last: bytes, stored: bytes) -> None:
        self.index.append((last, self.at, len(stored)))
        self.sink.write(stored + struct.pack("<I", zlib.crc32(stored)))
        self.at += len(stored) + 4

    def close(self) -> None:
        self._flush()
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray(bits + 7 >> 3)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        stored = struct.pack("<Q", bits) + bytes(bloom)
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        self.sink.write(stored + index)
        self.sink.write(FOOTER.pack(self.at, len(stored), self.at + len(stored), len(index), self.entries, self.ids << 8 | self.width, MAGIC))


class Reader:
    """Reads a shard: get() by Bloom filter, binary search in the index and in the block's restarts; scan() in key order."""

    def __init__(self, uri: str):
        fs, path = storage(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        bloom_at, bloom_n, index_at, index_n, self.entries, packed, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        self.ids, self.width = packed >> 8, packed & 255
        self.bloom = self._at(bloom_at, bloom_n)
        self.bits = struct.unpack_from("<Q", self.bloom)[0]
        raw, at, self.index = self._at(index_at, index_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.lasts = [k for k, _, _ in self.index]

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, offset, n = self.index[i]
        stored = self._at(offset, n + 4)
        if zlib.crc32(stored[:n]) != struct.unpack("<I", stored[n:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(stored[:n])
        count = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 - 4 * count], list(struct.unpack(f"<{count}I", raw[-4 - 4 * count : -4]))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, raw[at : at + n]
            at += n

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if self.width == 2 else "<u4")

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier; an empty list if there is none."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for i in range(bisect.bisect_left(self.lasts, key), len(self.index)):
            raw, restarts = self._block(i)
            whole = [next(self._entries(raw, r))[0] for r in restarts]
            for k, v in self._entries(raw, restarts[max(0, bisect.bisect_left(whole, key) - 1)]):
                if k == key:
                    found.append(self.array(v))
                elif k > key:
                    return found
        return found

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            raw, _ = self._block(i)
            for key, value in self._entries(raw, 0):
                yield id_of(key), self.array(value)

    def close(self) -> None:
        self.file.close()


#: Pre-tokens of byte-level BPE for texts of printable Latin only, where this class list and the library's pattern agree.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+|\\s+(?!\\S)|\\s+")
_OTHER = re.compile("[^\t\n\r -~\xa1-\u024f]")


class TextEncoder:
    """Whole texts to ids with the tokenizers library.

    BPE works on one pre-token at a time, so for texts of printable Latin each distinct pre-token goes through the library once and
    its ids are looked up from then on; texts with any other code point or with an added token's string go through it whole.
    """

    def __init__(self, path: str, cache: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if self.lib.truncation or self.lib.padding:
            self.lib.no_truncation()
            self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if _OTHER.search(t) or self.added and self.added.search(t) else _LATIN.findall(t) for t in texts]
        cache, new = self.cache, set()
        for ps in parts:
            if ps:
                new.update(set(ps).difference(cache))
        found, some = {}, list(new)
        for k in range(0, len(some), 10_000):
            chunk = some[k : k + 10_000]
            found.update(zip(chunk, (self._pack(e.ids) for e in self.lib.encode_batch_fast(chunk, add_special_tokens=False)), strict=True))
        if len(cache) + len(found) <= self.most:  # frequent pre-tokens come early; once the cache is full, it stays
            cache.update(found)
            found = {}
        out = []
        for t, ps in zip(texts, parts, strict=True):
            if ps is None:
                out.append(self._pack(self.lib.encode(t, add_special_tokens=False).ids))
                continue
            try:
                out.append(b"".join(map(cache.__getitem__, ps)))
            except KeyError:
                out.append(b"".join([cache.get(p) or found[p] for p in ps]))
        return out


_kept: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """One encoder a worker process and file, so that its cache outlives a task."""
    if path not in _kept:
        _kept[path] = TextEncoder(path)
    return _kept[path]


MANIFEST = "shard int, uri string, entries long, n_ids long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, shards: int | None = None, block_bytes: int = 1 << 16) -> DataFrame:
    """Encode every text and write the ids as shards in ascending identifier order over all shards; returns the manifest.

    The rows are dealt out by range of identifier (text hash and position next, so that one identifier with very many rows spreads
    over shards), sorted in their partition and streamed to one file each. A file's name holds the task attempt, and only files of
    the manifest count, so a repeated attempt leaves no doubt. Null text: no ids but the end id. Null identifiers come first.
    Repeated identifiers are all kept, side by side. No rows: an empty manifest.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = out or fresh(spark, "sstable")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("id"), F.asc("tie"), F.asc("at")]
    dealt = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)

    def write(it):
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = file = writer = first = last = None
        for batch in batches(it, "text"):
            if writer is None:
                enc = text_encoder(tokenizer_path)
                end = b"" if end_id is None else enc._pack([end_id])
                uri = f"{out}/{task.partitionId():06d}-{task.taskAttemptId()}.sst"
                fs, path = storage(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                file = fs.open_output_stream(path, compression=None)
                writer = Writer(file, enc.width, block_bytes)
                first = batch.column(0)[0].as_py()
            ids = batch.column(0).to_pylist()
            for doc_id, value in zip(ids, enc.encode(batch.column(1).to_pylist()), strict=True):
                writer.add(key_of(doc_id), value + end)
            last = ids[-1]
        if writer is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "uri": uri, "entries": writer.entries, "n_ids": writer.ids, "first_id": first, "last_id": last}], schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("entries", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    return cut(dealt.sortWithinPartitions(*order).select("id", "text").mapInArrow(write, MANIFEST), "sstable-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    placed = manifest.select("shard", "uri", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))  # one row a shard

    def read(it):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in it:
            for row in batch.to_pylist():
                reader, start, rows = Reader(row["uri"]), row["base"], []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the asked identifiers only: each is joined to the shards whose range holds it, then found by binary search.

    The manifest has one row a shard, so some hundred bytes for every shard's file, and is broadcast.
    """
    asked = ids.select(F.col(id_col).cast("long").alias("asked")).distinct()
    low = F.coalesce(F.col("first_id"), F.lit(-(1 << 63)))
    hit = asked.join(F.broadcast(manifest), (F.col("asked") >= low) & (F.col("asked") <= F.col("last_id")) | F.col("asked").isNull() & F.col("first_id").isNull())

    def read(it):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        open_: dict[str, Reader] = {}
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                if r["uri"] not in open_:
                    for old in open_.values():
                        old.close()
                    open_ = {r["uri"]: Reader(r["uri"])}
                rows += [{"doc_id": r["asked"], "ids": v.tolist()} for v in open_[r["uri"]].get(r["asked"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return hit.select("asked", "uri").repartition("uri").sortWithinPartitions("uri", "asked").mapInArrow(read, "doc_id long, ids array<long>")

"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard holds entries in ascending key order: blocks of prefix-compressed keys
with restart points, then a Bloom filter, a sparse index with the last key of
each block, and a footer. A lookup asks the Bloom filter, finds the block by
binary search in the index and the entry by binary search over the restarts.

Keys are 8 big-endian bytes of the identifier with its sign bit turned, so that
byte order is numeric order; a null identifier is the empty key and comes
first. Repeated identifiers are kept, side by side. A null text is empty; its
entry holds the end id alone. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import filesystem, scratch, slices, stored, task_id
from tallyforge.llm.tokens import encoder

MAGIC = b"TFSSTAB1"
#: index offset and size, filter offset and size, entries, bytes of an id, filter hashes, magic
FOOTER = struct.Struct("<QQQQQII8s")


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & (1 << 64) - 1)


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    low, high = h & (1 << 64) - 1, h >> 64 | 1
    return [(low + i * high) % (1 << 64) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to an open binary sink. Keys come in ascending order."""

    def __init__(self, sink, id_bytes: int, block_bytes: int = 1 << 16, restart: int = 16, bits_per_key: int = 10):
        self.sink, self.id_bytes, self.block_bytes, self.restart, self.bits_per_key = sink, id_bytes, block_bytes, restart, bits_per_key
        self.packer = zstandard.ZstdCompressor(level=1)
        self.at, self.entries, self.last = 0, 0, None
        self.index: list[tuple[bytes, int, int]] = []
        self.digests: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.in_block, self.restarts = 0, 0, []

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % self.restart == 0:
            self.restarts.append(self.size)
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (head, value)
        self.size += len(head) + len(value)
        if key != self.last:
            self.digests.append(key)
        self.last = key
        self.in_block += 1
        self.entries += 1
        if self.size >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = self.packer.compress(raw)
            self.index.append((self.last, *self._put(packed + struct.pack("<I", zlib.crc32(packed)))))
            self._new_block()

    def close(self) -> int:
        """Write what remains; returns the shard's size."""
        self._end_block()
        bits = max(64, len(self.digests) * self.bits_per_key + 7 & ~7)
        hashes = max(1, round(self.bits_per_key * 0.69))
        bloom = np.zeros(bits, np.uint8)
        for key in self.digests:
            bloom[_probes(key, hashes, bits)] = 1
        bloom_at = self._put(np.packbits(bloom).tobytes())
        index_at = self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        self._put(FOOTER.pack(*index_at, *bloom_at, self.entries, self.id_bytes, hashes, MAGIC))
        return self.at


class Reader:
    """Reads one shard from an open binary source with read_at()-like seek and read."""

    def __init__(self, source, size: int):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        foot = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.id_bytes, self.hashes, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(bloom_at, bloom_n)
        self.index, at, data = [], 0, self._read(index_at, index_n)
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            start, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, start, length))
        self.lasts = [k for k, _, _ in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        data = self._read(*self.index[i][1:])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        raw = self.unpacker.decompress(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        body = len(raw) - 4 * (n + 1)
        return raw[:body], list(struct.unpack(f"<{n}I", raw[body:-4]))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + size]
            at += size

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0], 0)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.hashes, 8 * len(self.bloom)))

    def get(self, key: bytes) -> list[bytes]:
        """The values of all entries with this key."""
        if not self.index or not self.may_hold(key):
            return []
        found = []
        for i in range(bisect_left(self.lasts, key), len(self.index)):
            raw, restarts = self._block(i)
            low, high = 0, len(restarts)
            while high - low > 1:  # the last restart whose key is smaller
                mid = (low + high) // 2
                low, high = (mid, high) if next(self._entries(raw, restarts[mid]))[0] < key else (low, mid)
            for k, v in self._entries(raw, restarts[low]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def open_shard(uri: str) -> Reader:
    files, path = filesystem(uri)
    return Reader(files.open_input_file(path), files.get_file_info(path).size)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block_bytes: int = 1 << 16, shard_bytes: int = 128 << 20) -> DataFrame:
    """Encode every text and write shards in ascending key order; returns the manifest of committed shards.

    Columns: shard, path, entries, ids, bytes, first_key, last_key. Shards are a
    range of identifiers each, of about shard_bytes of text at most; rows of one
    identifier that exceed a shard are dealt by the text's hash, and equal rows by
    their place in the input. Each attempt of a task writes a file of its
    own name and only the attempt that ends is in the manifest, so lost or
    doubled tasks do no harm.
    """
    folder = folder or scratch(docs.sparkSession, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(shards, "id", tie, "at").sortWithinPartitions("id", tie, "at").select("id", "text")

    def write(batches):
        enc, writer, files, sink, uri, ids, first, last = encoder(vocabulary), None, None, None, None, 0, None, None
        for batch in slices(batches, 1000):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    uri = f"{folder}/shard-{task_id():06d}-{uuid.uuid4().hex}.sst"
                    files, path = filesystem(uri)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(path, compression=None)
                    writer, first = Writer(sink, enc.dtype.itemsize, block_bytes), key
                value = enc.encode(text or "") + np.array([end_id], enc.dtype).tobytes()
                writer.add(key_of(key), value)
                ids, last = ids + len(value) // enc.dtype.itemsize, key
        if writer:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [task_id()], "path": [uri], "entries": [writer.entries], "ids": [ids], "bytes": [size], "first_key": pa.array([first], pa.int64()), "last_key": pa.array([last], pa.int64())})

    return stored(dealt.mapInArrow(write, "shard long, path string, entries long, ids long, bytes long, first_key long, last_key long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards in a manifest: id, start (ids of all entries before it), ids (binary, 32-bit little-endian)."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file, no more
    placed = manifest.select("shard", "path", before.alias("base"))
    n = manifest.count()

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, rows, held = open_shard(uri), [], 0
                for key, value in reader.items():
                    ids = np.frombuffer(value, f"<u{reader.id_bytes}").astype("<u4")
                    rows.append((identifier_of(key), start, ids.tobytes()))
                    start, held = start + len(ids), held + 4 * len(ids)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "start", "ids"])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "start", "ids"])

    return placed.repartitionByRange(max(1, n), "shard").mapInArrow(read, "id long, start long, ids binary")

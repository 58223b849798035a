"""Token ids in sorted-string tables: immutable files of documents keyed by identifier.

A file holds, in this order: data blocks, an index block, a Bloom filter and a footer of fixed size.
- A block is zstd-compressed. Its entries are sorted by key; each is (varint shared, varint own, varint size, key
  suffix, value), where shared counts the bytes that the key has in common with the one before it. Every RESTART-th
  entry has its whole key; the offsets of those (u32) and their number (u32) end the block, for binary search.
- The index has an entry for each data block: its last key -> offset u64, stored size u32, crc32 u32.
- The Bloom filter has BITS bits a key; its k probes come from the two halves of a 64-bit hash.
- The footer: offset u64 and size u32 of index and of filter, entries u64, ids u64, magic.
A key is one byte (0: no identifier, 1: identifier) and, for the latter, the identifier as 8 big-endian bytes with the
sign bit flipped, so that keys sort as identifiers do. A value is a byte for the width of an id (2 or 4) and the ids,
little-endian. Everything is found by binary search: index, then restarts.

Tables are written by range partitions, so the files' order is the order of identifiers. A task's attempt writes files
of its own name, and only files in the manifest that the job returns count, so a lost executor leaves no trace.

Defined results: a null or empty text has the end id alone; a null identifier sorts first; repeated rows are entries of
their own with equal keys, in the order of their contents' hash; other columns are not stored; an empty table has no
files."""

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
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, scratch, table
from ._tokens import Ids, word_pieces

END = 1
BLOCK_BYTES, FILE_BYTES, RESTART = 256 << 10, 48 << 20, 16
BITS, PROBES = 10, 7
MAGIC = b"RLSST\x00\x01\x00"
FOOTER = struct.Struct("<QIQIQQ8s")
PLACE = struct.Struct("<QII")


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (identifier + (1 << 63)) % (1 << 64))


def identifier_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def value_of(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


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


class Block:
    """Collects sorted entries."""

    def __init__(self):
        self.parts, self.size, self.restarts, self.n, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.n += 1
        self.last = key

    def done(self) -> bytes:
        return b"".join([*self.parts, struct.pack(f"<{len(self.restarts)}I", *self.restarts), struct.pack("<I", len(self.restarts))])


def _restarts(data: bytes) -> tuple[list[int], int]:
    n = struct.unpack_from("<I", data, len(data) - 4)[0]
    end = len(data) - 4 - 4 * n
    return list(struct.unpack_from(f"<{n}I", data, end)), end


def entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """From the restart at `at` on."""
    _, end = _restarts(data)
    key = b""
    while at < end:
        shared, at = _read_varint(data, at)
        own, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        key = key[:shared] + data[at : at + own]
        at += own
        yield key, data[at : at + size]
        at += size


def seek(data: bytes, key: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the first whose key is key or greater."""
    restarts, _ = _restarts(data)
    i = bisect_left(restarts, key, key=lambda at: next(entries(data, at))[0])
    return (e for e in entries(data, restarts[max(0, i - 1)]) if e[0] >= key)


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64).reshape(-1, 1)
    return (((h & np.uint64(0xFFFFFFFF)) + np.arange(PROBES, dtype=np.uint64) * (h >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


class Writer:
    def __init__(self, out):
        self.out, self.at, self.block, self.index, self.keys = out, 0, Block(), Block(), []
        self.entries = self.ids = 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.block.add(key, value_of(ids))
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        if self.block.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block.n:
            stored = self.packer.compress(self.block.done())
            at, size = self._put(stored)
            self.index.add(self.block.last, PLACE.pack(at, size, zlib.crc32(stored)))
            self.block = Block()

    def close(self) -> None:
        self._flush()
        index = self._put(self.packer.compress(self.index.done()))
        bits = max(64, BITS * len(self.keys) + 7 & ~7)
        filter_ = np.zeros(bits, np.uint8)
        filter_[_probes(self.keys, bits).ravel()] = 1
        bloom = self._put(np.packbits(filter_).tobytes())
        self._put(FOOTER.pack(*index, *bloom, self.entries, self.ids, MAGIC))
        self.out.close()


class Reader:
    """One file; only the footer, the index and the filter are kept in memory."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        ia, ilen, ba, blen, self.entries, self.ids, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {uri}")
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = self.unpacker.decompress(self._at(ia, ilen))
        self.bloom = np.unpackbits(np.frombuffer(self._at(ba, blen), np.uint8))

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, place: bytes) -> bytes:
        at, size, crc = PLACE.unpack(place)
        stored = self._at(at, size)
        if zlib.crc32(stored) != crc:
            raise ValueError("a block of a token table is damaged")
        return self.unpacker.decompress(stored)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, place in entries(self.index):
            for key, value in entries(self._block(place)):
                yield identifier_of(key), ids_of(value)

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every entry of the identifier in this file."""
        key = key_of(identifier)
        if not self.bloom[_probes([key], len(self.bloom))].all():
            return []
        out = []
        for _, place in seek(self.index, key):
            found = 0
            for k, value in seek(self._block(place), key):
                if k != key:
                    return out
                out.append(ids_of(value))
                found += 1
            if not found:
                break
        return out


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Writes tables of the ids of every document's whole text and end under folder, a URI that all executors reach.

    Returns the manifest: (path, part, nr, entries, ids, start), where start counts the ids of all files before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Ids.of(vocabulary, word_pieces)
        tail = np.array([end], "<u4").tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        writer, path, rows = None, "", []

        def close():
            writer.close()
            rows.append((path, part, len(rows), writer.entries, writer.ids))

        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                found = encoder.encode([t.as_py() or "" for t in b.column(1)])
                for identifier, ids in zip(b.column(0).to_pylist(), found):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        name = f"part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                        path = f"{folder}/{name}"
                        writer = Writer(fs.open_output_stream(f"{root}/{name}"))
                    writer.add(key_of(identifier), np.frombuffer(ids + tail, "<u4"))
                    if writer.at >= FILE_BYTES:
                        close()
                        writer = None
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "part", "nr", "entries", "ids"])

    order = [F.col("k").asc_nulls_first(), F.col("h")]
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    sorted_ = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    files = cut(sorted_.mapInArrow(run, "path string, part long, nr long, entries long, ids long"))
    before = Window.orderBy("part", "nr").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids as little-endian u32 bytes) of every entry of the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                held = 0
                for identifier, ids in Reader(path):
                    own = ids.tobytes()
                    rows.append((identifier, start, len(ids), zlib.crc32(own), own))
                    start += len(ids)
                    held += len(own)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("path", "start")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def lookup(manifest: DataFrame, identifiers: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few identifiers, by filter, index and binary search; for any number use read() and a join."""
    out: dict[int, list[np.ndarray]] = {i: [] for i in identifiers}
    for r in manifest.select("path").toLocalIterator():
        reader = Reader(r.path)
        for i in identifiers:
            out[i] += reader.get(i)
    return out


def op7_token_tables(spark, sf_dir: str) -> DataFrame:
    from .packing import vocabulary

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = cut(write(docs, scratch(spark, "tokens"), vocabulary("word_bpe_49k.json")))
    return read(manifest).drop("ids")

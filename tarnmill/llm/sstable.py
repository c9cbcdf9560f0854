"""Token-id output as sorted-string-table shards, written and read where the tasks run.

A shard file holds documents by ascending key:

    data block *    entries, restart points (uint32 each), their number (uint32), crc32 (uint32)
    index block     per data block: last key, offset, size
    Bloom filter    bits over the document ids, then the number of hashes (uint8)
    footer          index offset and size, Bloom offset and size, documents, tokens (uint64 each),
                    bytes per id (uint8), magic

An entry: varint of the key bytes shared with the entry before, varint of the others, varint of the
value's length, the other key bytes, the value (the ids, little-endian). Every 16th entry is a
restart point, which shares nothing. A key orders as its document: a byte (0 for a null id), the id
in big-endian with the sign bit turned, and the place among rows of the same id in this shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, texts_of
from .tokens import encoder

MAGIC = b"TMSST1\r\n"
RESTART = 16
BLOCK_BYTES = 1 << 15
#: A shard is closed at so many bytes of ids; only a single longer document makes it larger.
SHARD_BYTES = 16 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Tasks that read shards, at most; each may read several.
MOST_TASKS = 20_000
_FOOTER = struct.Struct("<6QB8s")


def key_of(doc_id: int | None, copy: int) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63), copy)


def id_of(key: bytes) -> int | None:
    known, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if known else None


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
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h, step = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1
    return [(h + k * step) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Collects the entries of one shard, in key order, as the bytes of its file."""

    def __init__(self, id_bytes: int):
        self.id_bytes = id_bytes
        self.out, self.index, self.keys = bytearray(), [], []
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries, self.last = self.entries + 1, key
        self.keys.append(key)
        self.tokens += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.entries:
            body = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.index.append((self.last, len(self.out), len(body) + 4))
            self.out += body + struct.pack("<I", zlib.crc32(body))
            self.block, self.restarts, self.entries = bytearray(), [], 0

    def finish(self) -> bytes:
        self._close_block()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for b in _bloom_places(key, 8 * len(bloom)):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom.append(BLOOM_HASHES)
        at = len(self.out)
        footer = _FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.id_bytes, MAGIC)
        return bytes(self.out + index + bloom) + footer


class ShardReader:
    """Reads a shard from an open random-access file: all of it in order, or a document by its id."""

    def __init__(self, file, size: int):
        self.file = file
        at, n, bloom_at, bloom_n, self.docs, self.tokens, self.id_bytes, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        data, self.index = self._read(at, n), []
        k = 0
        while k < len(data):
            size, k = _read_varint(data, k)
            key, k = data[k : k + size], k + size
            offset, k = _read_varint(data, k)
            length, k = _read_varint(data, k)
            self.index.append((key, offset, length))
        self.bloom = self._read(bloom_at, bloom_n)[:-1]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        data = self._read(*self.index[k][1:])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block of the shard is damaged")
        n = struct.unpack("<I", data[-8:-4])[0]
        end = len(data) - 8 - 4 * n
        return data[:end], np.frombuffer(data, "<u4", n, end).tolist()

    @staticmethod
    def _entries(data: bytes, at: int):
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + other], at + other
            yield key, data[at : at + size]
            at += size

    def scan(self):
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0], 0)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each row of a document: Bloom filter, then binary search over blocks and restart points."""
        first, found = key_of(doc_id, 0), []
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_places(first, 8 * len(self.bloom))):
            return found
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < first else (lo, mid)
        for k in range(lo, len(self.index)):
            data, restarts = self._block(k)
            a, b = 0, len(restarts)
            while b - a > 1:  # the last restart point whose key isn't greater
                mid = (a + b) // 2
                a, b = (mid, b) if next(self._entries(data, restarts[mid]))[0] <= first else (a, mid)
            for key, value in self._entries(data, restarts[a]):
                if key[:9] == first[:9]:
                    found.append(value)
                elif key > first:
                    return found
        return found


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file under another name first, so that what bears the name is whole."""
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/_{name}") as f:
        f.write(data)
    where.move(f"{path}/_{name}", f"{path}/{name}")


_MANIFEST = "part int, shard int, file string, docs long, tokens long, before long, first long, last long"


def _write(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        shard, before, writer, last, copy, first = 0, 0, ShardWriter(width), (), 0, None

        def close():
            # A name of its own for each attempt: the manifest, which is committed with the job, names the right one.
            name = f"{part:06d}-{shard:05d}-{uuid.uuid4().hex}.sst"
            _put(folder, name, writer.finish())
            values = [part, shard, name, len(writer.keys), writer.tokens, before, id_of(writer.keys[0]), id_of(writer.last)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int32() if k < 2 else pa.int64()) for k, v in enumerate(values)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

        for batch in batches:
            docs, texts = batch.column(0).cast(pa.int64()).to_pylist(), texts_of(batch.column(1))
            for lo, hi in by_size(texts):
                for doc, ids in zip(docs[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    copy = copy + 1 if last == (doc,) else 0
                    last = (doc,)
                    writer.add(key_of(doc, copy), ids + end)
                    if len(writer.out) >= SHARD_BYTES:
                        yield close()
                        before += writer.tokens
                        shard, writer = shard + 1, ShardWriter(width)
        if writer.keys:
            yield close()

    return write


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs(doc_id, text, ...)`` as shards in ``folder`` and returns the manifest, kept there as Parquet.

    Documents are dealt out by ranges of ``doc_id`` (null first, then ascending; rows of one id by
    text), tokenized and written by the tasks themselves. ``folder`` is one that all executors reach. A
    null or empty text is the end id alone; repeated rows are entries of their own; an empty table
    makes a manifest without rows. Shards that the manifest doesn't name come from lost attempts.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(_write(folder, tokenizer, end_id), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _read(folder: str, bases: dict[int, int]):
    def read(batches):
        where, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, name, before in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with where.open_input_file(f"{path}/{name}") as f:
                    shard, start = ShardReader(f, f.size()), bases[part] + before
                    kind, rows, size = np.dtype(f"<u{shard.id_bytes}"), [], 0
                    for key, value in shard.scan():
                        ids = np.frombuffer(value, kind).astype("<u4").tobytes()
                        rows.append((id_of(key), start, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size >= 1 << 22:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return read


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """All documents of the shards that a manifest names: ``doc_id``, ``start`` (ids of all before it), ``ids`` (little-endian uint32)."""
    sums = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("shards")).orderBy("part").collect()
    bases = dict(zip([r.part for r in sums], accumulate((r.tokens for r in sums), initial=0)))
    shards = sum(r.shards for r in sums)
    files = manifest.select("part", "file", "before").repartition(max(1, min(shards, MOST_TASKS)), "file")
    return files.mapInArrow(_read(folder, bases), "doc_id long, start long, ids binary")


def lookup(manifest: DataFrame, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row of one document, from the shards whose key range holds its id."""
    near = manifest.where(F.lit(doc_id).cast("long").isNull() & F.col("first").isNull() | (F.col("last") >= F.lit(doc_id)) & (F.coalesce("first", F.lit(-(1 << 63))) <= F.lit(doc_id)))
    found = []
    where, path = pafs.FileSystem.from_uri(folder)
    for r in near.orderBy("part", "shard").collect():
        with where.open_input_file(f"{path}/{r.file}") as f:
            shard = ShardReader(f, f.size())
            found += [np.frombuffer(v, f"<u{shard.id_bytes}") for v in shard.get(doc_id)]
    return found

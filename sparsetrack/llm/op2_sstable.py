"""Sorted-string-table shards of token ids, keyed by document.

File: data blocks, index, Bloom filter, footer.  A data block holds entries in key order, each as varint lengths (key
bytes shared with the previous entry, key bytes of its own, value), key rest and value; every 16th entry shares nothing
(a restart) and the block ends with the restarts' places and their number.  Blocks are zstd frames.  The index has each
block's last key, place and length, so one binary search finds the only block a key can be in; the Bloom filter (10 bits
and 7 probes a key) says beforehand that most absent keys are absent.  The footer has all places, counts and a magic.

Keys: a flag byte (0: null), doc_id big-endian with its sign bit turned, and an ordinal among rows of one doc_id.
Null ids come first.  Values: ids as little-endian unsigned 16-bit integers, the end id last.  Null texts are empty;
every row, repeated ones too, gets its entry (rows of one doc_id in the order of their texts' hashes).
An empty table has no shards and an empty result.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_dir, keyed, record, written
from .tokenize import encoder, public_path

END, MAGIC = 2, b"STRKSST1"
BLOCK, SHARD, RESTART = 64 << 10, 128 << 20, 16
FOOTER = struct.Struct("<7Q8s")
PROBES, BITS = 7, 10


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63) if doc_id is not None else 0, ordinal)


def id_of(key: bytes) -> int | None:
    flag, biased, _ = struct.unpack(">BQI", key)
    return biased - (1 << 63) if flag else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> np.ndarray:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return np.array([(a + i * b) % bits for i in range(PROBES)], np.int64)


class Writer:
    """Entries must come in key order."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=3)
        self._new()

    def _new(self) -> None:
        self.body, self.restarts, self.n, self.last, self.size = [], [], 0, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.body.append(entry)
        self.size += len(entry)
        self.n += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // 2
        if self.size >= self.block:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = b"".join(self.body) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            frame = self.pack.compress(raw)
            self.index.append((self.last, self.at, len(frame)))
            self.out.write(frame)
            self.at += len(frame)
            self._new()

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<13sQQ", *x) for x in self.index)
        bits = max(64, -(-BITS * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_probes(k, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), bits, len(self.keys), self.tokens, MAGIC))


def entries_of(frame: bytes) -> Iterator[tuple[bytes, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
    end, at, key = len(raw) - 4 - 4 * n, 0, b""
    while at < end:
        shared, at = _read_varint(raw, at)
        own, at = _read_varint(raw, at)
        size, at = _read_varint(raw, at)
        key = key[:shared] + raw[at : at + own]
        at += own
        yield key, raw[at : at + size]
        at += size


class Reader:
    """A shard: ``scan`` in key order, ``get`` by Bloom filter, binary search of the index and of a block's restarts."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        *places, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, n, bloom_at, bloom_n, self.bits, self.count, self.tokens = places
        self.index = list(struct.iter_unpack("<13sQQ", self._read(at, n)))
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_n), np.uint8)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from entries_of(self._read(at, n))

    def may_have(self, doc_id: int | None) -> bool:
        p = _probes(key_of(doc_id), self.bits)
        return bool((self.bloom[p >> 3] >> (p & 7) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of a document."""
        if not self.may_have(doc_id):
            return []
        low, out = key_of(doc_id), []
        for i in range(bisect.bisect_left(self.index, low, key=lambda x: x[0]), len(self.index)):
            for key, value in self._from(self._read(*self.index[i][1:]), low):
                if key[:9] > low[:9]:
                    return out
                if key[:9] == low[:9]:
                    out.append(np.frombuffer(value, "<u2"))
        return out

    @staticmethod
    def _from(frame: bytes, low: bytes) -> Iterator[tuple[bytes, bytes]]:
        """A block's entries from the last restart at or before ``low``."""
        raw = zstandard.ZstdDecompressor().decompress(frame)
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        restarts = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)

        def first_key(at: int) -> bytes:
            _, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            _, at = _read_varint(raw, at)
            return raw[at : at + own]

        at, end, key = restarts[max(0, bisect.bisect_right(restarts, low, key=first_key) - 1)], len(raw) - 4 - 4 * n, b""
        while at < end:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + size]
            at += size


def _open(path: str, mode: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_output_stream(inner) if mode == "w" else fs.open_input_file(inner)


def _make_dir(path: str) -> None:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)


MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST_SQL = "path string, part long, n_docs long, n_tokens long"


def _write(folder: str, vocabulary: str, shard: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), struct.pack("<H", END)
        part, made = TaskContext.get().partitionId(), []
        w = sink = path = None
        last, ordinal = None, 0

        def close():
            w.close()
            sink.close()
            made.append((path, (part << 32) + len(made), len(w.keys), w.tokens))

        for b in it:
            for lo in range(0, b.num_rows, 200):
                piece = b.slice(lo, 200)
                values = enc.encode_all(piece.column("text").to_pylist())
                for doc_id, value in zip(piece.column("doc_id").to_pylist(), values, strict=True):
                    if w is None:
                        # an attempt that dies leaves a file that no manifest names
                        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.sst"
                        sink = _open(path, "w")
                        w = Writer(sink)
                        last = ()
                    ordinal = ordinal + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    w.add(key_of(doc_id, ordinal), value + end)
                    if w.at + w.size > shard:
                        close()
                        w = None
        if w is not None:
            close()
        yield record(MANIFEST, zip(*made, strict=True) if made else [[]] * 4)

    return run


def write_shards(docs: DataFrame, vocabulary: str | None = None, shard: int = SHARD) -> DataFrame:
    """Write all documents as shards in ascending doc_id order; the manifest: path, part (shard order), n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "sstable")
    _make_dir(folder)
    dealt = keyed(docs).repartitionByRange("did", "th").sortWithinPartitions("did", "th")
    return written(dealt.select("doc_id", "text").mapInArrow(_write(folder, vocabulary or public_path(), shard), MANIFEST_SQL), "manifest")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
READ_SQL = "doc_id long, start long, n_tokens long, ids binary"


def _read_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for row in b.to_pylist():
            with _open(row["path"], "r") as f:
                start, out, size = row["start"], [], 0
                for key, value in Reader(f).scan():
                    ids = np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    out.append((id_of(key), start, len(value) // 2, ids))
                    start += len(value) // 2
                    size += len(ids)
                    if size > 8 << 20:
                        yield record(READ, zip(*out, strict=True))
                        out, size = [], 0
                if out:
                    yield record(READ, zip(*out, strict=True))


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start (ids before it in the whole set), n_tokens, ids (unsigned 32-bit, little-endian).

    The manifest has a row for each shard (of about 128 MB); only that comes to the driver.
    """
    spark, start, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():
        rows.append((r["path"], start))
        start += r["n_tokens"]
    if not rows:
        return spark.createDataFrame([], READ_SQL)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "path string, start long").mapInArrow(_read_all, READ_SQL)


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))



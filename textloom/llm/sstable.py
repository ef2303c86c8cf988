"""Token-ID output as sorted-string tables: documents by identifier in prefix-compressed blocks.

File layout (all numbers little-endian)::

    block*   entries of ascending keys; an entry is
             shared u8 | rest u8 | key[shared:] | start u64 | n_tokens u32 | body_crc u32 | ids (u16 each, or u32 where the flag says)
             ``shared`` is the length of the prefix that the key has in common with the key before it in the block; a block's first is 0
    index    a line for each block: key length u8 | first key | offset u64 | length u32 | entries u32
    bloom    n_bits u64 | n_hashes u32 | bits
    footer   index offset u64 | index length u32 | bloom offset u64 | bloom length u32 | blocks u32 | entries u64 | id width u8 | magic

A key is a byte that is 0 for a null identifier and 1 for others, so that null sorts first; the identifier as 8 bytes, big-endian with
the sign bit turned, so that bytes sort as numbers do; then an ordinal of 4 bytes for rows of a shard that share an identifier. Rows
of one identifier may lie in several neighbouring shards, each of which numbers its own.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, table
from .tokens import encoder

MAGIC = b"TLSST002"
FOOTER = struct.Struct("<QIQIIQB8s")
ENTRY = struct.Struct("<QII")
LINE = struct.Struct("<QII")
BLOCK = 256 * 1024
BITS, HASHES = 10, 7
#: Bytes of a key without its ordinal.
OWN = 9
END = 0


def key(doc_id: int | None, ordinal: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else doc_id + 2**63, ordinal)


def unkey(k: bytes) -> int | None:
    return struct.unpack(">Q", k[1:OWN])[0] - 2**63 if k[0] else None


def _bits(k: bytes, n_bits: int) -> Iterator[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(k, 7)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return ((a + i * b) % n_bits for i in range(HASHES))


class Writer:
    """Writes one shard to an open binary file, holding one block and the block index."""

    def __init__(self, file, width: int = 2, block: int = BLOCK):
        self.file, self.width, self.block = file, width, block
        self.at, self.buf, self.first, self.last, self.n = 0, bytearray(), b"", b"", 0
        self.index, self.keys, self.entries = [], [], 0

    def add(self, k: bytes, start: int, ids: np.ndarray) -> None:
        if self.keys and k <= self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.n:
            self.first, shared = k, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(k, self.last)) if x != y), min(len(k), len(self.last)))
        body = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.buf += bytes((shared, len(k) - shared)) + k[shared:] + ENTRY.pack(start, len(ids), zlib.crc32(body)) + body
        self.last, self.n, self.entries = k, self.n + 1, self.entries + 1
        self.keys.append(k)
        if len(self.buf) >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            self.file.write(self.buf)
            self.index.append((self.first, self.at, len(self.buf), self.n))
            self.at, self.buf, self.n = self.at + len(self.buf), bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(bytes((len(k),)) + k + LINE.pack(at, size, n) for k, at, size, n in self.index)
        n_bits = max(64, BITS * self.entries)
        bits = np.zeros(-(-n_bits // 8), "u1")
        for k in self.keys:
            for b in _bits(k[:OWN], n_bits):
                bits[b >> 3] |= 1 << (b & 7)
        bloom = struct.pack("<QI", n_bits, HASHES) + bits.tobytes()
        self.file.write(index + bloom)
        self.file.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.index), self.entries, self.width, MAGIC))


class Reader:
    """Random access to one shard through a seekable file: footer, sparse index and Bloom filter first, then single blocks."""

    def __init__(self, file, size: int):
        self.file = file
        foot = self._at(size - FOOTER.size, FOOTER.size)
        at, n, self.bloom_at, self.bloom_n, _, self.entries, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, self.index, i = self._at(at, n), [], 0
        while i < len(raw):
            k = raw[i + 1 : i + 1 + raw[i]]
            i += 1 + raw[i]
            self.index.append((k, *LINE.unpack_from(raw, i)))
            i += LINE.size
        self.bloom = None

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        _, at, size, n = self.index[i]
        raw, p, k = self._at(at, size), 0, b""
        for _ in range(n):
            shared, rest = raw[p], raw[p + 1]
            k = k[:shared] + raw[p + 2 : p + 2 + rest]
            p += 2 + rest
            start, count, crc = ENTRY.unpack_from(raw, p)
            p += ENTRY.size
            body = raw[p : p + count * self.width]
            if zlib.crc32(body) != crc:
                raise ValueError(f"broken entry {k.hex()}")
            p += len(body)
            yield k, start, np.frombuffer(body, "<u2" if self.width == 2 else "<u4")

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(start, ids) of each document of this identifier, by Bloom filter, then binary search in the block index."""
        if self.bloom is None:
            self.bloom = self._at(self.bloom_at, self.bloom_n)
        k = key(doc_id)[:OWN]
        n_bits = struct.unpack_from("<Q", self.bloom)[0]
        if not all(self.bloom[12 + (b >> 3)] >> (b & 7) & 1 for b in _bits(k, n_bits)):
            return []
        i, out = max(0, bisect_right(self.index, k, key=lambda x: x[0]) - 1), []
        while i < len(self.index) and self.index[i][0][:OWN] <= k:
            out += [(s, ids) for own, s, ids in self.block(i) if own[:OWN] == k]
            i += 1
        return out


def open_fs(uri: str):
    """The file system and path of a URI, on any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 5_000) -> list[dict]:
    """Encode whole texts and write them as shards that ascend by identifier below ``folder``, which executors must share.

    Rows are dealt by identifier and text hash, so a hot identifier is split over shards. A task writes to a name of its own and
    renames when the shard is whole, so a repeated task leaves one file for each name in the list that is returned. Null texts are
    empty texts: one end id. Starts in a file count from the shard's first document; a shard's ``base`` holds all ids before it.
    Extra columns are ignored.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession, docs.count(), per_shard)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("salt"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "salt").sortWithinPartitions(F.col("id").asc_nulls_first(), "salt")

    def task(batches):
        from pyspark import TaskContext

        part, store, writer, out, enc = TaskContext.get().partitionId(), None, None, None, None
        total, last, ordinal, ends = 0, object(), 0, []
        for batch in batches:
            if writer is None:
                enc = encoder(tokenizer, END)
                store, at = open_fs(folder)
                store.create_dir(at, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.sst"
                out = store.open_output_stream(f"{at}/.{name}")
                writer = Writer(out, 2 if enc.model.get_vocab_size() <= 65536 else 4)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 256):
                for doc, e in zip(ids[i : i + 256], enc.encode(texts.slice(i, 256).to_pylist())):
                    tokens = np.frombuffer(e, "<u4")
                    ordinal = ordinal + 1 if doc == last else 0
                    last = doc
                    writer.add(key(doc, ordinal), total, tokens)
                    total += len(tokens)
                    ends = [ends[0] if ends else doc, doc]
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{at}/.{name}", f"{at}/{name}")
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "tokens": total, "entries": writer.entries, "first": ends[0], "last": ends[1]}], schema=schema)

    schema = pa.schema([("part", pa.int64()), ("name", pa.string()), ("tokens", pa.int64()), ("entries", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    # one row a shard comes to the driver, never documents
    shards = rows.mapInArrow(task, "part long, name string, tokens long, entries long, first long, last long").collect()
    out, base = [], 0
    for s in sorted(shards, key=lambda s: s["part"]):
        out.append(s.asDict() | {"base": base})
        base += s["tokens"]
    return out


def read(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Every document of the shards: doc_id, start (over all shards), ids. One task a shard, block by block."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def task(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            store, at = open_fs(f"{folder}/{r['name']}")
            with store.open_input_file(at) as f:
                reader = Reader(f, f.size())
                for i in range(len(reader.index)):
                    rows = [{"doc_id": unkey(k), "start": s + r["base"], "ids": t} for k, s, t in reader.block(i)]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _list(spark, shards).mapInArrow(task, "doc_id long, start long, ids array<int>")


def _list(spark: SparkSession, shards: list[dict]) -> DataFrame:
    rows = [(s["name"], s["base"]) for s in shards]
    return spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))


def digests(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            store, at = open_fs(f"{folder}/{r['name']}")
            with store.open_input_file(at) as f:
                rows = [(unkey(k), s + r["base"], len(t), zlib.crc32(t.astype("<u4").tobytes())) for k, s, t in Reader(f, f.size())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return _list(spark, shards).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as they are read back from shards written in the shared folder."""
    import public_tokenizers

    with Workspace(spark, "op7") as ws:
        folder = ws.path("shards")
        shards = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
        return ws.result(digests(spark, folder, shards))

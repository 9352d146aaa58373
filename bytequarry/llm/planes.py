"""Token ids in files of bit-plane shuffled, compressed chunks.

A shard file holds the ids of a run of documents in ascending doc_id order:

    8 bytes   BQPLANE1
    chunks    each a fixed count of ids (the last may be shorter), transposed into planes: plane p
              holds bit p (or byte p) of every id; each plane is compressed by itself (zstandard)
    documents doc_ids (64-bit, 0 for null), null marks, counts of ids (32-bit); compressed
    index     one row a chunk: its offset (64-bit) and the length of each plane (32-bit)
    trailer   little-endian: index offset, documents offset, ids, documents, ids of a chunk (64-bit
              each), planes, bits of a plane (32-bit each), BQPLANE1

Any chunk can be read by itself through the index. Shards are written below the session's shared
folder, under a name of the attempt's own, and counted only through the manifest that successful
attempts leave; a lost executor's task writes its shard anew.

Defined results: null text counts as empty (its ids are the end id alone); a text of any length is encoded whole and
may span chunks; rows of one doc_id keep one order, by a hash of their ids and by these; a null doc_id comes first;
an empty table gives no file and no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import id_buckets, map_batches, open_file, partitions, scratch, texts, written
from bytequarry.llm.tokens import encoder, vocabulary

MAGIC = b"BQPLANE1"
TRAILER = struct.Struct("<5Q2I8s")
CHUNK_IDS = 1 << 16


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of 32-bit ids: bits 1: 32 planes of packed bits; bits 8: 4 planes of bytes."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(as_bytes[:, p]).tobytes() for p in range(4)]
    as_bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(as_bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    as_bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(as_bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    """A shard, built chunk by chunk into a binary file object."""

    def __init__(self, out, bits: int = 8, chunk_ids: int = CHUNK_IDS, level: int = 3) -> None:
        self.out, self.bits, self.chunk_ids = out, bits, chunk_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at, self.index, self.n_ids = [], 0, 0, [], 0
        self.doc_ids, self.nulls, self.counts = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append(struct.pack(f"<Q{len(planes)}I", self.at, *map(len, planes)))
        self._put(b"".join(planes))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.chunk_ids * self.chunk_ids
            for i in range(0, whole, self.chunk_ids):
                self._chunk(flat[i : i + self.chunk_ids])
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        docs_at = self.at
        self._put(self.zip.compress(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.counts, "<u4").tobytes()))
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(TRAILER.pack(index_at, docs_at, self.n_ids, len(self.doc_ids), self.chunk_ids, 32 // self.bits, self.bits, MAGIC))


class ShardReader:
    """A shard from a seekable binary file object."""

    def __init__(self, source) -> None:
        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell() - TRAILER.size
        index_at, docs_at, self.n_ids, n_docs, self.chunk_ids, n_planes, self.bits, magic = TRAILER.unpack(self._read(end, TRAILER.size))
        if magic != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a shard file")
        row = struct.Struct(f"<Q{n_planes}I")
        self.index = list(row.iter_unpack(self._read(index_at, end - index_at)))
        docs = self.zip.decompress(self._read(docs_at, index_at - docs_at))
        self.doc_ids, self.nulls, self.counts = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs), np.frombuffer(docs, "<u4", n_docs, 9 * n_docs)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, i: int) -> np.ndarray:
        offset, *lengths = self.index[i]
        data, planes, at = self._read(offset, sum(lengths)), [], 0
        for n in lengths:
            planes.append(self.zip.decompress(data[at : at + n]))
            at += n
        return from_planes(planes, min(self.chunk_ids, self.n_ids - i * self.chunk_ids), self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document, holding a document and a chunk at a time."""
        held, i = np.zeros(0, "<u4"), 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(i))
                have += len(parts[-1])
                i += 1
            flat = np.concatenate(parts) if len(parts) > 1 else held
            held = flat[n:]
            yield None if null else doc_id, flat[:n]


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", words: bool = True, end_id: int | None = 1) -> DataFrame:
    """doc_id and ids (little-endian 32-bit, with the end id) of every text. tokenizer: a vocabulary file's name."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(vocabulary(tokenizer), words).ids
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ids(t) + end for t in texts(batch)], pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids binary")


def write(docs: DataFrame, encoded: DataFrame, bits: int = 8, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Write encoded (doc_id, ids) into shard files; the manifest: shard, path, n_ids, n_docs, start (ids of the shards before).

    docs: a table with the same doc_ids, cheap to scan, for the shards' bounds.
    """
    spark = docs.sparkSession
    bucket, count = id_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id")), max(1, partitions(spark)), tie="tie")
    folder = scratch(spark, "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, path, out, sink, n = None, None, None, None, 0
        for batch in batches:
            for s, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if out is None:
                    shard, path = s, f"{folder}/shard-{s:06d}-{uuid.uuid4().hex}.bqp"
                    sink = open_file(path, "w")
                    out = ShardWriter(sink, bits, chunk_ids)
                elif s != shard:
                    raise RuntimeError("two shards in one task")
                out.add(doc_id, np.frombuffer(ids, "<u4"))
                n += 1
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([out.n_ids], pa.int64()), pa.array([n], pa.int64())], ["shard", "path", "n_ids", "n_docs"])

    # rows of one doc_id, or of none, that are too many for one shard are dealt out by a hash of their ids
    dealt = encoded.withColumn("tie", F.xxhash64("ids")).withColumn("bucket", bucket)
    dealt = dealt.repartitionById(count, "bucket").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids").drop("tie")
    manifest = written(dealt.mapInArrow(run, "shard int, path string, n_ids long, n_docs long"), "planes-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with keep_ids the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                with open_file(path, "r") as source:
                    for doc_id, ids in ShardReader(source).documents():
                        data = ids.tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(data), *([data] if keep_ids else [])))
                        start += len(ids)
                        size += len(data) if keep_ids else 32
                        if size > 8 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    spark = manifest.sparkSession
    return manifest.repartition(max(1, partitions(spark)), "shard").select("path", "start").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

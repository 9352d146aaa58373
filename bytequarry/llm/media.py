"""Texts as lossless images: stored as WebP files, read back into pixel arrays, with features.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are rows of 24 samples.
Up to 384 rows are one WebP file; a longer payload is a sequence of files one after the other, each of
which tells its own length.

Defined results: null text counts as empty (576 bytes 255); texts of any length are stored whole; equal texts give
equal values; repeated rows repeat; an empty table gives no rows; columns besides doc_id and text, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm import webp
from bytequarry.llm.common import raw_texts

WIDTH = 24
UNIT = 576
TILE = WIDTH * 384
#: Files that are decoded side by side.
LANES = 2000


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def store(data: bytes) -> list[bytes]:
    """The WebP files of a payload."""
    return webp.encode_samples([data[i : i + TILE] for i in range(0, len(data), TILE)], WIDTH)


def files(media: bytes) -> list[bytes]:
    """The files of a stored sequence."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def feature(pixels: np.ndarray) -> str:
    """An average hash of 8 x 8 fields, with the mean and deviation of all samples (in 256ths)."""
    rows = np.add.reduceat(pixels.astype(np.int64), np.arange(8) * len(pixels) // 8, axis=0)
    fields = rows.reshape(8, 8, -1).sum(axis=2) / np.diff(np.append(np.arange(8) * len(pixels) // 8, len(pixels)))[:, None]
    hashed = int(np.packbits(fields.reshape(-1) > fields.mean()).view(">u8")[0])
    return f"{hashed:016x}:{round(float(pixels.mean()) * 256)}:{round(float(pixels.std()) * 256)}"


def through_images(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Per document, from the stored bytes read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with keep the media too."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if keep else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def solved(ids: list, raw: list[bytes]) -> pa.RecordBatch:
        media = [b"".join(store(payload(t))) for t in raw]
        parts = [files(m) for m in media]
        pixels = webp.decode_many([f for p in parts for f in p])
        rows, at = [], 0
        for doc_id, t, m, p in zip(ids, raw, media, parts, strict=True):
            image = np.concatenate(pixels[at : at + len(p)])
            at += len(p)
            back = image.tobytes()
            rows.append((doc_id, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(image), *([m] if keep else [])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("doc_id").to_pylist(), raw_texts(batch)
            start, tiles = 0, 0
            for i, t in enumerate(raw):
                tiles += 1 + len(t) // TILE
                if tiles >= LANES or i + 1 == len(raw):
                    yield solved(ids[start : i + 1], raw[start : i + 1])
                    start, tiles = i + 1, 0

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

"""Synthetic assets from the tables of the data set: archives, loose files, scripts, images, audio."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import dsc_many, image, jvm
from bytequarry.functions.binary import encrypt, le_u32_bytes
from bytequarry.functions.formats import ARCHIVE_ENTRY, ARCHIVE_MAGIC, ARCHIVE_NAME, AUDIO_MAGIC, CODE_END, FILE_OPCODE, FUNCTION, SCRIPT_MAGIC, STRING_OPCODE

#: Entries of an archive, so that no archive grows with the table.
PER_ARCHIVE = 64
#: Archives that are made at once.
AT_ONCE = 32
SCRIPT_KINDS = ("name", "text", "ruby_kanji", "ruby_furigana", "backlog", "file", "other")
#: Zero words before a script's first reference, so that no opcode can pass for one.
LEAD_WORDS = 96
BLOCK_WORDS = {"0.00": 16, "1.00": 8}


def write_archive(items: list[tuple[str, bytes]]) -> bytes:
    table, at = bytearray(), 0
    for name, data in items:
        table += struct.pack(f"<{ARCHIVE_NAME}sII{ARCHIVE_ENTRY - ARCHIVE_NAME - 8}x", name.encode("cp932"), at, len(data))
        at += len(data)
    return ARCHIVE_MAGIC + struct.pack("<I", len(items)) + bytes(table) + b"".join(d for _, d in items)


def write_audio(payload: bytes, head: int = 64, size: int | None = None) -> bytes:
    return struct.pack("<I4sI", head, AUDIO_MAGIC, len(payload) if size is None else size).ljust(head, b"\0") + payload


def audio_column(payload: Column, head: int = 64) -> Column:
    """write_audio as a column expression."""
    return F.concat(F.lit(struct.pack("<I", head)), F.lit(AUDIO_MAGIC), le_u32_bytes(F.octet_length(payload)), F.lit(bytes(head - 12)), payload)


def write_script(version: str, texts: list[bytes], kinds: list[str] | None = None) -> bytes:
    """A script with one reference a text; a text of the kind `text` names the first as its speaker."""
    kinds = kinds or [SCRIPT_KINDS[i % 7] for i in range(len(texts))]
    wide = BLOCK_WORDS[version]
    n = LEAD_WORDS + wide * len(texts)
    words, size, at = [0] * n, 4 * n + len(CODE_END), 0
    ahead = {"0.00": {"name": 9, "text": 11, "ruby_kanji": 5, "ruby_furigana": 3, "backlog": 3}, "1.00": {"name": 3, "text": 1, "ruby_kanji": 1, "ruby_furigana": 3, "backlog": 3}}[version]
    for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
        p = LEAD_WORDS + wide * i + 2
        words[p] = size + at
        words[p - 1] = {"file": FILE_OPCODE, "other": 0}.get(kind, STRING_OPCODE)
        if kind in ahead:
            words[p + ahead[kind]] = FUNCTION[kind]
        if kind == "text":
            words[p + (2 if version == "0.00" else -2)] = size
        at += len(text) + 1
    head = SCRIPT_MAGIC + struct.pack("<I", 4) if version == "1.00" else b""
    return head + np.array(words, "<u4").tobytes() + CODE_END + b"".join(t + b"\0" for t in texts)


def text_image(data: bytes, width: int = 8) -> image.Image:
    padded = data + b"\xff" * (-len(data) % (4 * width) or (0 if data else 4 * width))
    return image.Image(width, len(padded) // (4 * width), image.has_alpha(padded), padded)


def entry_contents(docs: list[dict], mixed: bool) -> list[bytes]:
    """Documents (doc_id, text) as entries: as they are, or by turns one of six kinds of file."""
    out = [entry_content(d["doc_id"], d["text"], mixed) for d in docs]
    scripts = [i for i, d in enumerate(docs) if mixed and d["doc_id"] % 6 == 2]
    for i, packed in zip(scripts, dsc_many.encode([out[i] for i in scripts]), strict=True):
        out[i] = packed
    return out


def entry_content(doc_id: int, text: str, mixed: bool) -> bytes:
    """A document as an entry; the script is not compressed yet."""
    data = (text or "").encode()
    which = doc_id % 6 if mixed else 0
    if which == 1:
        return write_audio(data)
    if which == 2:
        return write_script("1.00", [data])
    if which == 3:
        return image.encode(text_image(data))
    if which == 4:
        return b"\x89PNG\r\n\x1a\n" + data
    if which == 5:
        return write_audio(data, size=len(data) + 1)
    return data


def entry_column(spark: SparkSession) -> Column | None:
    """entry_content of a row's doc_id and text, mixed and with the script compressed; null where the JVM's codecs leave it to Python, None without them."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.octet_length(data)
    fill = F.substring(F.lit(b"\xff" * 32), F.lit(1), F.when(size == 0, 32).otherwise(F.pmod(-size, F.lit(32))))
    packed = jvm.column(spark, "pack", F.concat(F.lit(write_script("1.00", [b""])[:-1]), data, F.lit(b"\0")))
    painted = jvm.column(spark, "paint", F.concat(F.lit(struct.pack("<I", 8)), data, fill))
    if packed is None or painted is None:
        return None
    cut = F.concat(F.lit(struct.pack("<I", 64)), F.lit(AUDIO_MAGIC), le_u32_bytes(size + 1), F.lit(bytes(52)), data)
    which = F.pmod("doc_id", F.lit(6))
    return F.when(which == 1, audio_column(data)).when(which == 2, packed).when(which == 3, painted).when(which == 4, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), data)).when(which == 5, cut).otherwise(data)


def archive_path() -> Column:
    """The archive that a document is in."""
    return F.format_string("%s-%06d.arc", F.col("source"), F.floor(F.col("doc_id") / PER_ARCHIVE))


def archives(docs: DataFrame, mixed: bool = False) -> DataFrame:
    """arc_path, content: archives of up to 64 documents of a source, in doc_id order."""
    # so many partitions as named: what an archive costs is not in its bytes
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(archive_path().alias("arc_path"), "doc_id", "text").repartition(n, "arc_path")
    made = entry_column(docs.sparkSession) if mixed else None
    rows = rows.withColumn("content", F.lit(None).cast("binary") if made is None else made)
    rows = rows.groupBy("arc_path").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "content"))).alias("docs"))
    # the text alone where the content is still to be made
    rows = rows.withColumn("docs", F.transform("docs", lambda d: F.struct(d.doc_id.alias("doc_id"), F.when(d.content.isNull(), d.text).alias("text"), d.content.alias("content"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, held = batch.column("arc_path").to_pylist(), batch.column("docs")
            for at in range(0, len(paths), AT_ONCE):
                some = held[at : at + AT_ONCE].to_pylist()
                left = iter(entry_contents([d for docs in some for d in docs if d["content"] is None], mixed))
                content = iter([next(left) if d["content"] is None else d["content"] for docs in some for d in docs])
                for path, docs in zip(paths[at : at + AT_ONCE], some, strict=True):
                    made = write_archive([(f"text\\doc_{d['doc_id']:08d}.bin", next(content)) for d in docs])
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made], pa.binary())], ["arc_path", "content"])

    return rows.mapInArrow(run, "arc_path string, content binary")


def plain(text: str | None) -> str:
    """A text with `{XXXX}` for each character that is not ASCII, so that any code page has it."""
    text = text or ""
    return text if text.isascii() else "".join(c if ord(c) < 128 else f"{{{ord(c):04X}}}" for c in text)


def scripts(conversations: DataFrame, packed: bool = False) -> DataFrame:
    """script, version, content: a script a conversation, a text a turn (see plain); odd ones are version 1.00."""
    if packed:
        # so many partitions as named: packing costs far more than their bytes
        conversations = conversations.repartition(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, out = batch.column("conv_id").to_pylist(), []
            versions = ["1.00" if conv % 2 else "0.00" for conv in convs]
            for version, turns in zip(versions, batch.column("turns").to_pylist(), strict=True):
                out.append(write_script(version, [plain(t["text"]).encode() for t in turns]))
            columns = [f"conv_{conv:06d}" for conv in convs], versions, dsc_many.encode(out) if packed else out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], ["script", "version", "content"])

    return rows.select("conv_id", "turns").mapInArrow(run, "script string, version string, content binary")


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, samples: the 64 values as samples 0 to 255."""
    return embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("samples"))


@lru_cache
def tree_codes(weights: tuple[int, ...]) -> dict[int, str]:
    """The bits of each symbol of a version 2 code."""
    tree = image.WeightTree(list(weights))
    out, open_ = {}, [(tree.root, "")]
    while open_:
        node, bits = open_.pop()
        if node in tree.children:
            open_ += [(child, bits + side) for side, child in zip("01", tree.children[node], strict=True) if child >= 0]
        else:
            out[node] = bits
    return out


def write_image_2(width: int, strips: list[list[dict[int, int]]], quantisers: bytes, alpha: bytes = b"") -> bytes:
    """A version 2 image of whole strips of 8 rows; a block is {place in zigzag order: value}, all of luma first, then both chromas."""
    weights = (1,) * 16, (1,) * 176
    first, later = map(tree_codes, weights)
    bits_of = lambda v: (abs(v).bit_length(), "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}")
    whole = lambda text: int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big") if text else b""
    bodies = []
    for blocks in strips:
        head, tail, level = "", "", 0
        for block in blocks:
            size, bits = bits_of(block.get(0, 0) - level)
            level = block.get(0, 0)
            head += first[size] + bits
            at = 0
            for place in sorted(k for k in block if k and block[k]):
                size, bits = bits_of(block[place])
                # a gap of 16 a time, then the zeros left before the value
                gaps, zeros = divmod(place - at - 1, 16)
                if zeros == 15 and not size:
                    raise ValueError("a value of no bits")
                tail += later[image.GAP] * gaps + later[size << 4 | zeros] + bits
                at = place
            if at < 63:
                tail += later[image.BLOCK_END]
        bodies.append(bytes((width // 8 + 7) // 8) + image.put_varint(64 * len(blocks)) + whole(head) + whole(tail))
    clear = b"".join(image.put_varint(w) for row in weights for w in row)
    start = len(clear) + 4 * (len(bodies) + 1)
    offsets = [start + sum(map(len, bodies[:i])) for i in range(len(bodies) + 1)]
    xor = 0
    for b in quantisers:
        xor ^= b
    head = image.HEAD.pack(image.IMAGE_MAGIC, width, 8 * len(strips), 32 if alpha else 24, 0, 7, len(quantisers), sum(quantisers) & 255, xor, 2)
    return head + encrypt(quantisers, 7) + clear + struct.pack(f"<{len(offsets)}i", *offsets) + b"".join(bodies) + alpha


def wave_images(samples: DataFrame) -> DataFrame:
    """vec_id, content: version 2 images of 16 x 8 pixels from the samples s.

    The left block is grey s[0] with a wave of s[3] % 41 - 20 (quantiser 3) along the rows, the right one
    grey s[1]; alpha is s[2] everywhere.
    """
    quantisers = bytes([1, 3, *[1] * 62]) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column("samples").to_pylist():
                luma = [{0: 8 * (s[0] - 128), 1: s[3] % 41 - 20}, {0: 8 * (s[1] - 128)}]
                # one sample, then a copy of 130 from the left neighbour
                alpha = b"\1\0\0\0" + bytes([2, s[2]]) + struct.pack("<H", 63 | 127 << 9)
                out.append(write_image_2(16, [[*luma, {}, {}, {}, {}]], quantisers, alpha))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "content"])

    return samples.select("vec_id", "samples").mapInArrow(run, "vec_id long, content binary")


def grey_images(samples: DataFrame) -> DataFrame:
    """vec_id, content: version 1 images of 8 x 8 grey pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column("samples").to_pylist():
                pixels = np.full((64, 4), 255, np.uint8)
                pixels[:, :3] = np.array(values, np.uint8)[:, None]
                out.append(image.encode(image.Image(8, 8, False, pixels.tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "content"])

    return samples.select("vec_id", "samples").mapInArrow(run, "vec_id long, content binary")

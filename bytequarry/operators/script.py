"""Scripts as relations: code words, text slots, references, entries; and patches of their text.

A script is (script string, content binary), compressed or not. Code words and slots come from one
table function each; the rest is joins, windows and aggregates on (script, ...).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import codepage, dsc, dsc_many
from bytequarry.functions.binary import FILE_ERRORS
from bytequarry.functions.formats import CODE_END, COMMENT, DISTANCE, FILE_OPCODE, FUNCTION, RANK, SCRIPT_MAGIC, STRING_OPCODE

KIND_ORDER = ("name", "text", "ruby_kanji", "ruby_furigana", "backlog")


def layout(content: bytes, plain: bytes | None = None) -> tuple[str, str, bytes, bytes, bytes]:
    """(container, version, header, code, text) of a script; plain: what a compressed one unpacks to, where it is known."""
    container = "dsc" if dsc.is_packed(content) else "compiled"
    data = content if container != "dsc" else dsc.decode(content) if plain is None else plain
    version, head = "0.00", 0
    if data[: len(SCRIPT_MAGIC)] == SCRIPT_MAGIC:
        version = "1.00"
        at = len(SCRIPT_MAGIC)
        head = at + (struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0)
    end = data.rfind(CODE_END)
    end = len(data) if end < 0 else end + 4
    if head > end:
        raise ValueError("the header passes the code's end")
    return container, version, data[:head], data[head:end], data[end:]


def split_slots(text: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the NUL-ended strings; empty ones count, a last one may lack its NUL."""
    if text in (b"", b"\0"):
        return []
    parts = text.split(b"\0")
    if not parts[-1]:
        parts.pop()
    out, at = [], 0
    for p in parts:
        out.append((at, p))
        at += len(p) + 1
    return out


def _table(scripts: DataFrame, rows_of: Callable[[bytes], list[tuple]], schema: str, kinds: list[pa.DataType], bad: Callable[[str], list[tuple]] = lambda _: []) -> DataFrame:
    """rows_of every script; of one that cannot be read, the rows that `bad` gives for its error."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for script, content in zip(batch.column("script").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = rows_of(content or b"")
                except FILE_ERRORS as e:
                    found = bad(str(e))
                rows += [(script, *r) for r in found]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), *kinds], strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), *kinds], strict=True)], names)

    return scripts.select("script", "content").mapInArrow(run, schema)


def opened(scripts: DataFrame) -> DataFrame:
    """script, content: compressed scripts unpacked; those that are not sound, or are compressed twice, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("content").to_pylist()
            packed = [i for i, data in enumerate(held) if data and dsc.is_packed(data)]
            for i, text in zip(packed, dsc_many.sound([held[i] for i in packed]), strict=True):
                if text is None:
                    try:
                        text = dsc.decode(held[i])
                    except FILE_ERRORS:
                        continue
                if not dsc.is_packed(text):
                    held[i] = text
            yield pa.RecordBatch.from_arrays([batch.column("script"), pa.array(held, pa.binary())], ["script", "content"])

    # words, slots and errors read the same exchange; so many partitions as named: what a script costs is not in its bytes
    n = int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scripts.select("script", "content").mapInArrow(run, "script string, content binary").repartition(n, "script")


def words(scripts: DataFrame) -> DataFrame:
    """script, version, code_len, word_no, value: the whole 32-bit words of each script's code; none of one that cannot be read."""

    def rows(content: bytes) -> list[tuple]:
        _, version, _, code, _ = layout(content)
        return [(version, len(code), i, v) for i, v in enumerate(np.frombuffer(code, "<u4", len(code) // 4).tolist())]

    return _table(scripts, rows, "script string, version string, code_len long, word_no int, value long", [pa.string(), pa.int64(), pa.int32(), pa.int64()])


def unreadable(scripts: DataFrame) -> DataFrame:
    """script, error of every script that cannot be read."""

    def rows(content: bytes) -> list[tuple]:
        layout(content)
        return []

    return _table(scripts, rows, "script string, error string", [pa.string()], lambda error: [(error,)])


def slots(scripts: DataFrame) -> DataFrame:
    """script, slot_no, slot_offset, bytes; a script that cannot be read has none."""

    def rows(content: bytes) -> list[tuple]:
        return [(i, o, b) for i, (o, b) in enumerate(split_slots(layout(content)[4]))]

    return _table(scripts, rows, "script string, slot_no int, slot_offset long, bytes binary", [pa.int32(), pa.int64(), pa.binary()])


def classified(code_words: DataFrame) -> DataFrame:
    """code_words with kind and speaker_value: what a reference at the word would be, and the word that would name its speaker."""
    order = Window.partitionBy("script").orderBy("word_no")
    opcode = F.lag("value", 1).over(order)
    kind = F.when(opcode == FILE_OPCODE, "file").when(opcode.isNull() | (opcode != STRING_OPCODE), "other")
    for name in KIND_ORDER:
        ahead = {v: F.lead("value", d[name] // 4).over(order) for v, d in DISTANCE.items()}
        holds = F.when(F.col("version") == "0.00", ahead["0.00"]).otherwise(ahead["1.00"]) == FUNCTION[name]
        kind = kind.when(F.coalesce(holds, F.lit(False)), name)
    steps = {v: (d["text"] - d["name"]) // 4 for v, d in DISTANCE.items()}
    speaker = F.when(F.col("version") == "0.00", F.lead("value", steps["0.00"]).over(order)).otherwise(F.lag("value", -steps["1.00"]).over(order))
    return code_words.withColumns({"kind": kind.otherwise("other"), "speaker_value": speaker})


def references(code_words: DataFrame, text_slots: DataFrame, page: int = 932) -> DataFrame:
    """script, pos (byte offset in the code), text_offset, kind, comment, bytes of every word that points to a slot."""
    found = classified(code_words).where((F.col("word_no") >= 1) & (F.col("value") >= F.col("code_len")))
    found = found.withColumn("text_offset", F.col("value") - F.col("code_len"))
    own = text_slots.select("script", F.col("slot_offset").alias("text_offset"), "bytes")
    names = text_slots.select("script", F.col("slot_offset").alias("speaker_offset"), F.col("bytes").alias("speaker"))
    found = found.join(own, ["script", "text_offset"]).withColumn(
        "speaker_offset", F.when((F.col("kind") == "text") & (F.col("speaker_value") != 0), F.pmod(F.col("speaker_value") - F.col("code_len"), F.lit(1 << 32)))
    )
    found = found.join(names, ["script", "speaker_offset"], "left")
    comment = F.create_map(*[F.lit(x) for pair in COMMENT.items() for x in pair])[F.col("kind")]
    named = F.concat(comment, F.lit(" 【"), codepage.decoded("speaker", page), F.lit("】"))
    return found.select("script", (F.col("word_no").cast("long") * 4).alias("pos"), "text_offset", "kind", F.when(F.col("speaker").isNotNull(), named).otherwise(comment).alias("comment"), "bytes")


def rank_of(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[kind]


def merged(refs: DataFrame, page: int = 932) -> DataFrame:
    """script, index, text_offset, kind, comment, code_offsets, original_text: an entry a text offset.

    The reference of the highest rank gives kind and comment, the earliest of equal ones.
    """
    best = F.max_by(F.struct("kind", "comment"), F.struct(rank_of("kind"), -F.col("pos")))
    rows = refs.groupBy("script", "text_offset").agg(best.alias("b"), F.array_sort(F.collect_list("pos")).alias("code_offsets"), F.first("bytes").alias("bytes"))
    index = F.row_number().over(Window.partitionBy("script").orderBy("text_offset"))
    return rows.select("script", index.alias("index"), "text_offset", F.col("b.kind").alias("kind"), F.col("b.comment").alias("comment"), "code_offsets", codepage.decoded("bytes", page).alias("original_text"))


def entries(scripts: DataFrame, page: int = 932, fail_fast: bool = False) -> DataFrame:
    """merged(references()) of scripts, with error: a script that cannot be read is one row of its error and nulls; with fail_fast it fails the query."""
    scripts = opened(scripts)
    found = merged(references(words(scripts), slots(scripts), page), page).withColumn("error", F.lit(None).cast("string"))
    bad = unreadable(scripts)
    error = F.raise_error(F.col("error")).cast("string") if fail_fast else F.col("error")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in ("script", "error")]
    return found.unionByName(bad.select("script", *nulls, error.alias("error")))


def relocated(text_slots: DataFrame, new_bytes: DataFrame) -> DataFrame:
    """script, slot_no, slot_offset, new_offset, bytes: slots with their replacements (script, text_offset, new) and where they move to."""
    new = new_bytes.select("script", F.col("text_offset").alias("slot_offset"), "new")
    rows = text_slots.join(new, ["script", "slot_offset"], "left").withColumn("bytes", F.coalesce("new", "bytes")).drop("new")
    before = Window.partitionBy("script").orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("script", "slot_no", "slot_offset", F.coalesce(F.sum(F.octet_length("bytes") + 1).over(before), F.lit(0)).alias("new_offset"), "bytes")


def patched_words(code_words: DataFrame, moved: DataFrame) -> DataFrame:
    """code_words with the words that point to slots pointing to where those are now."""
    to = moved.select("script", F.col("slot_offset").alias("__at"), "new_offset")
    rows = code_words.withColumn("__at", F.when((F.col("word_no") >= 1) & (F.col("value") >= F.col("code_len")), F.col("value") - F.col("code_len")))
    return rows.join(to, ["script", "__at"], "left").withColumn("value", F.coalesce(F.col("code_len") + F.col("new_offset"), "value")).drop("__at", "new_offset")


def replacements(project_entries: DataFrame, page: int = 0) -> DataFrame:
    """script, text_offset, new, error: the bytes of each project entry; the last of equal offsets, `dst` unless it is empty.

    page 0: the page that the project names. A project that could not be read keeps its error.
    """
    last = Window.partitionBy("script", "text_offset").orderBy(F.col("entry_no").desc())
    rows = project_entries.withColumn("__k", F.row_number().over(last)).where("__k = 1")
    text = F.when(F.col("translation_text") != "", F.col("translation_text")).otherwise(F.col("original_text"))
    rows = rows.select("script", "text_offset", "error", codepage.encoded(text, page or F.col("encode_cp")).alias("e"))
    return rows.select("script", "text_offset", F.col("e.value").alias("new"), F.coalesce("error", "e.error").alias("error"))


def rebuild(content: bytes, new: dict[int, bytes]) -> bytes:
    """A script with the slots at the given offsets replaced, compressed if it was."""
    container, _, head, code, text = layout(content)
    found = split_slots(text)
    moved, at, parts = {}, 0, []
    for offset, old in found:
        moved[offset] = at
        parts.append(new.get(offset, old))
        at += len(parts[-1]) + 1
    values = np.frombuffer(code, "<u4", len(code) // 4).astype(np.int64)
    for i in np.flatnonzero(values >= len(code)):
        if i and (to := moved.get(int(values[i]) - len(code))) is not None:
            values[i] = len(code) + to
    out = head + values.astype("<u4").tobytes() + code[len(values) * 4 :] + b"".join(p + b"\0" for p in parts)
    return dsc.encode(out) if container == "dsc" else out


def apply_project(scripts: DataFrame, project_entries: DataFrame, page: int = 0) -> DataFrame:
    """script, patched, error: scripts with their projects' texts; a text that cannot be encoded is the script's error."""
    new = replacements(project_entries, page).groupBy("script").agg(F.collect_list(F.struct("text_offset", "new")).alias("new"), F.min("error").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for script, content, new, error in zip(*(batch.column(c).to_pylist() for c in ("script", "content", "new", "error")), strict=True):
                out = None
                if error is None:
                    try:
                        out = rebuild(content, {x["text_offset"]: x["new"] for x in new or []})
                    except FILE_ERRORS as e:
                        error = str(e)
                rows.append((script, out, error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], ["script", "patched", "error"])

    return scripts.select("script", "content").join(new, "script", "left").mapInArrow(run, "script string, patched binary, error string")


def script_entries(content: bytes, page: int = 932, plain: bytes | None = None) -> tuple[str, list[dict]]:
    """(container, entries) of one script, the per-script form of `entries`."""
    container, version, _, code, text = layout(content, plain)
    held = dict(split_slots(text))
    values = np.frombuffer(code, "<u4", len(code) // 4).tolist()
    get = lambda i: values[i] if 0 <= i < len(values) else None
    distance, found = DISTANCE[version], {}
    for i in range(1, len(values)):
        offset = values[i] - len(code)
        if offset not in held:
            continue
        kind = "other"
        if values[i - 1] == FILE_OPCODE:
            kind = "file"
        elif values[i - 1] == STRING_OPCODE:
            kind = next((k for k in KIND_ORDER if get(i + distance[k] // 4) == FUNCTION[k]), "other")
        comment = COMMENT[kind]
        if kind == "text" and (speaker := get(i + (distance["text"] - distance["name"]) // 4)) and speaker - len(code) in held:
            comment += f" 【{codepage.decode(held[speaker - len(code)], page)}】"
        info = found.setdefault(offset, {"kind": kind, "comment": comment, "code_offsets": []})
        if RANK[kind] > RANK[info["kind"]]:
            info.update(kind=kind, comment=comment)
        info["code_offsets"].append(4 * i)
    return container, [{"index": n, "text_offset": o, **found[o], "original_text": codepage.decode(held[o], page)} for n, o in enumerate(sorted(found), 1)]

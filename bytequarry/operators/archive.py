"""Archives as tables: one row in, a row an entry out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions.binary import as_column, le_u32
from bytequarry.functions.codepage import archive_name
from bytequarry.functions.formats import ARCHIVE_ENTRY, ARCHIVE_HEAD, ARCHIVE_MAGIC, ARCHIVE_NAME


def is_archive(content: Column | str) -> Column:
    """At least 16 bytes with the archive's signature."""
    content = as_column(content)
    return (F.octet_length(content) >= ARCHIVE_HEAD) & F.startswith(content, F.lit(ARCHIVE_MAGIC))


def guard_path(path: Column | str) -> Column:
    """struct<path, error>: the relative path with `/` between its parts, or why it is refused.

    Refused: rooted and drive paths, `..`, and what has no part left. Empty and `.` parts go.
    """
    flat = F.replace(as_column(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    error = (
        F.when(flat.startswith("/") | flat.rlike("^[A-Za-z]:"), "absolute path")
        .when(F.array_contains(parts, ".."), "parent path")
        .when(F.size(parts) == 0, "empty path")
    )
    return F.struct(F.when(error.isNull(), F.array_join(parts, "/")).alias("path"), error.alias("error"))


def read_directory(content: bytes, page: int = 932) -> list[tuple[str, int, int]]:
    """(name, offset, size) of each entry; an error in one fails the archive."""
    if len(content) < ARCHIVE_HEAD or content[:12] != ARCHIVE_MAGIC:
        raise ValueError("not an archive")
    n = struct.unpack_from("<I", content, 12)[0]
    base = ARCHIVE_HEAD + ARCHIVE_ENTRY * n
    if base > len(content):
        raise ValueError("the entry table passes the end")
    out = []
    for at in range(ARCHIVE_HEAD, base, ARCHIVE_ENTRY):
        offset, size = struct.unpack_from("<II", content, at + ARCHIVE_NAME)
        if base + offset + size > len(content):
            raise ValueError(f"entry {len(out)} passes the end")
        out.append((archive_name(content[at : at + ARCHIVE_NAME], page), offset, size))
    return out


_SCHEMA = "arc_path string, entry_index int, name string, offset long, size long, error string"


def _entries(archives: DataFrame, with_content: bool, page: int, fail_fast: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an archive at a time, so that no more than one is held twice
            for path, content in zip(batch.column("arc_path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                try:
                    rows = [(path, i, n, o, s, None) for i, (n, o, s) in enumerate(read_directory(data, page))]
                except ValueError as e:
                    if fail_fast:
                        raise
                    rows = [(path, None, None, None, None, str(e))]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                if not rows:
                    continue
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_content:
                    base = ARCHIVE_HEAD + ARCHIVE_ENTRY * len(rows)
                    arrays.append(pa.array([None if r[5] else data[base + r[3] : base + r[3] + r[4]] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["arc_path", "entry_index", "name", "offset", "size", "error", *(["content"] if with_content else [])])

    rows = archives.select("arc_path", "content").mapInArrow(run, _SCHEMA + ", content binary" * with_content)
    safe = guard_path("name")
    error = F.coalesce("error", safe.error)
    if fail_fast:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    columns = ["arc_path", "entry_index", safe.path.alias("path"), "offset", "size", *(["content"] if with_content else []), error.alias("error")]
    return rows.select(*columns)


def list_entries(archives: DataFrame, page: int = 932, fail_fast: bool = False) -> DataFrame:
    """arc_path, entry_index, path, offset, size, error of every entry of archives (arc_path, content).

    A bad archive is one row with its error and nulls; with fail_fast it fails the query.
    """
    return _entries(archives, False, page, fail_fast)


def extract_entries(archives: DataFrame, page: int = 932, fail_fast: bool = False) -> DataFrame:
    """list_entries with each entry's content."""
    return _entries(archives, True, page, fail_fast)


def directory_columns(archives: DataFrame) -> DataFrame:
    """The listing in column functions alone, for ASCII names and sound archives: arc_path, entry_index, name, offset, size."""
    n = le_u32("content", 12)
    rows = archives.select("arc_path", F.substring("content", F.lit(1), (n * ARCHIVE_ENTRY + ARCHIVE_HEAD).cast("int")).alias("head"), n.cast("int").alias("n")).where("n > 0")
    rows = rows.select("arc_path", "head", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("entry_index"))
    at = F.col("entry_index") * ARCHIVE_ENTRY + ARCHIVE_HEAD
    return rows.select(
        "arc_path", "entry_index", F.regexp_replace(F.decode(F.substring("head", at + 1, F.lit(ARCHIVE_NAME)), "US-ASCII"), "\u0000.*", "").alias("name"),
        le_u32("head", at + ARCHIVE_NAME).alias("offset"), le_u32("head", at + ARCHIVE_NAME + 4).alias("size"),
    )

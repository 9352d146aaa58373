"""Scans of files and archives, and a data source that reads archive directories alone."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bytequarry.functions.binary import FILE_ERRORS
from bytequarry.functions.codepage import archive_name
from bytequarry.functions.formats import ARCHIVE_ENTRY, ARCHIVE_HEAD, ARCHIVE_MAGIC, ARCHIVE_NAME
from bytequarry.operators.archive import is_archive


def scan(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of all regular files below the paths, each once.

    A path below another one of the paths is left out, and one that is not there as well (paths with
    wildcards are taken as they are, and should not overlap). Content is read only where it is selected.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    flat = sorted({p.rstrip("/") or "/" for p in paths})
    kept = [p for p in flat if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in flat)]
    found = [p for p in kept if set(p) & set("*?[{") or _is_there(spark, p)]
    if not found:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return reader.load(found)


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scan_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """arc_path, content of the archives below the paths, each once: by extension first, then by signature.

    No content is shuffled, so rows have no order: order what is made of them by arc_path.
    """
    files = scan(spark, *paths, glob="*.[aA][rR][cC]").where(F.col("length") >= ARCHIVE_HEAD).where(is_archive("content"))
    return files.select(F.col("path").alias("arc_path"), "content")


class _Archives(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.page, self.each = options["path"], int(options.get("codepage", 932)), int(options.get("archivespertask", 64))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + os.path.abspath(self.root.removeprefix("file:")))

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        if store.get_file_info(root).is_file:
            found = [root]
        else:
            # names alone come to the driver
            listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            found = sorted(f.path for f in listed if f.is_file and f.path.lower().endswith(".arc"))
        return [_Archives(found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            try:
                yield from self._entries(store, path)
            except (*FILE_ERRORS, OSError) as e:
                yield path, None, None, None, None, str(e)

    def _entries(self, store: fs.FileSystem, path: str) -> list[tuple]:
        with store.open_input_file(path) as source:
            size, head = source.size(), source.read(ARCHIVE_HEAD)
            if len(head) < ARCHIVE_HEAD or head[:12] != ARCHIVE_MAGIC:
                return []
            n = struct.unpack_from("<I", head, 12)[0]
            base = ARCHIVE_HEAD + ARCHIVE_ENTRY * n
            if base > size:
                raise ValueError("the entry table passes the end")
            table, out = source.read(ARCHIVE_ENTRY * n), []
        for i in range(n):
            row = table[ARCHIVE_ENTRY * i : ARCHIVE_ENTRY * (i + 1)]
            offset, length = struct.unpack_from("<II", row, ARCHIVE_NAME)
            if base + offset + length > size:
                raise ValueError(f"entry {i} passes the end")
            out.append((path, i, archive_name(row[:ARCHIVE_NAME], self.page), offset, length, None))
        return out


class ArchiveDirectory(DataSource):
    """format("archive_directory"): arc_path, entry_index, name, offset, size, error, reading only 16 + 128 n bytes of each archive.

    The path is a folder or file on any file system that pyarrow opens (file, HDFS, S3 ...); archivesPerTask
    of them are read in one task. An archive that cannot be read is one row of its error; a file that is none gives no row.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_directory"

    def schema(self) -> str:
        return "arc_path string, entry_index int, name string, offset long, size long, error string"

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options)

"""The codecs and table functions by name, for SQL text.

After register(spark): dsc_decode, dsc_encode, image_decode, image_encode, codepage_decode and
codepage_encode are functions; archive_entries, script_slots and project_entries are table functions
(`FROM t, LATERAL archive_entries(t.content)`). Codecs give a struct with an error, table functions a row
with one; null gives null, or no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import codepage, dsc, image
from bytequarry.functions.binary import FILE_ERRORS
from bytequarry.operators.archive import read_directory
from bytequarry.operators.script import layout, split_slots
from bytequarry.sources.projects import parse_text


def _bytes_codec(fn):
    @F.pandas_udf("value binary, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            try:
                rows.append((None if x is None else fn(bytes(x)), None))
            except FILE_ERRORS as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def _image_decode():
    names = ["width", "height", "has_alpha", "pixels", "error"]

    @F.pandas_udf("width int, height int, has_alpha boolean, pixels binary, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            try:
                i = None if x is None else image.decode(bytes(x))
                rows.append([None] * 5 if i is None else [i.width, i.height, i.has_alpha, i.pixels, None])
            except FILE_ERRORS as e:
                rows.append([None, None, None, None, str(e)])
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="Int32" if k < 2 else object) for k, n in enumerate(names)})

    return run


def _image_encode():
    @F.pandas_udf("value binary, error string")
    def run(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        rows = []
        for w, h, p in zip(width, height, pixels, strict=True):
            try:
                whole = p is not None and not pd.isna(w) and not pd.isna(h)
                rows.append((image.encode(image.Image(int(w), int(h), image.has_alpha(bytes(p)), bytes(p))) if whole else None, None))
            except FILE_ERRORS as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def _codepage_decode():
    @F.pandas_udf("string")
    def run(values: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(p) else codepage.decode(bytes(x), int(p)) for x, p in zip(values, pages, strict=True)], dtype=object)

    return run


def _rows(content: bytes | None, read, width: int):
    """read(content) with a null error on each row; nulls and the error where it fails."""
    if content is not None:
        try:
            for row in read(bytes(content)):
                yield *row, None
        except FILE_ERRORS as e:
            yield *[None] * width, str(e)


class ArchiveEntries:
    def eval(self, content: bytes):
        yield from _rows(content, lambda data: [(i, *e) for i, e in enumerate(read_directory(data))], 4)


class ScriptSlots:
    def eval(self, content: bytes):
        yield from _rows(content, lambda data: [(i, *x) for i, x in enumerate(split_slots(layout(data)[4]))], 3)


class ProjectEntries:
    def eval(self, content: bytes):
        fields = ("index", "text_offset", "kind", "comment", "code_offsets", "original_text", "translation_text")
        yield from _rows(content, lambda data: [tuple(e[f] for f in fields) for e in parse_text(data.decode("utf-8"))[1]], len(fields))


def register(spark: SparkSession) -> None:
    """Register all of the names above in the session."""
    functions = {
        "dsc_decode": _bytes_codec(dsc.decode), "dsc_encode": _bytes_codec(dsc.encode), "image_decode": _image_decode(), "image_encode": _image_encode(),
        "codepage_decode": _codepage_decode(), "codepage_encode": codepage.encoder(),
    }
    tables = {
        "archive_entries": (ArchiveEntries, "entry_index int, name string, offset long, size long, error string"),
        "script_slots": (ScriptSlots, "slot_no int, slot_offset long, bytes binary, error string"),
        "project_entries": (ProjectEntries, "index int, text_offset long, kind string, comment string, code_offsets array<bigint>, original_text string, translation_text string, error string"),
    }
    for name, fn in functions.items():
        spark.udf.register(name, fn)
    for name, (cls, schema) in tables.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))

"""What an asset is, by its first bytes, and how outputs are named."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.binary import as_column, le_u32
from bytequarry.functions.formats import AUDIO_MAGIC, IMAGE_MAGIC, KINDS, PACKED_SCRIPT_MAGIC, PATCHED_SUFFIX, PROJECT_SUFFIX, SCRIPT_MAGIC


def kind_of(content: Column | str) -> Column:
    """The kind's key; the first test that holds wins."""
    data = as_column(content)
    tests = [
        ("image", 0, IMAGE_MAGIC), ("dsc", 0, PACKED_SCRIPT_MAGIC), ("compiled", 0, SCRIPT_MAGIC), ("audio", 4, AUDIO_MAGIC),
        ("png", 0, b"\x89PNG\r\n\x1a\n"), ("jpeg", 0, b"\xff\xd8\xff"), ("bmp", 0, b"BM"), ("ogg", 0, b"OggS"),
    ]
    out = None
    for name, at, magic in tests:
        holds = F.substring(data, at + 1, len(magic)) == F.lit(magic)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    wav = (F.substring(data, 1, 4) == F.lit(b"RIFF")) & (F.substring(data, 9, 4) == F.lit(b"WAVE"))
    return out.when(wav, "wav").otherwise("unknown")


def _of_kind(kind: Column, which: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[which])])[kind]


def classify(files: DataFrame) -> DataFrame:
    """files (path, content) with kind, label and suggested_extension."""
    rows = files.withColumn("kind", kind_of("content"))
    return rows.withColumns({"label": _of_kind(F.col("kind"), 0), "suggested_extension": _of_kind(F.col("kind"), 1)})


def audio_payload(content: Column | str) -> Column:
    """struct<payload, error>: the bytes that an audio container holds."""
    data = as_column(content)
    head, size = le_u32(data, 0), le_u32(data, 8)
    error = F.when((F.octet_length(data) < 12) | (F.substring(data, 5, 4) != F.lit(AUDIO_MAGIC)), "not an audio container").when(head + size > F.octet_length(data), "the payload passes the end")
    return F.struct(F.when(error.isNull(), F.substring(data, (head + 1).cast("int"), size.cast("int"))).alias("payload"), error.alias("error"))


def has_suffix(path: Column | str, suffix: str) -> Column:
    """The path ends so, whatever its case."""
    return F.lower(as_column(path)).endswith(suffix.lower())


def output_name(path: Column | str, kind: Column | str) -> Column:
    """The path of what a file of a kind is converted to; null for kinds that are not."""
    path, kind = as_column(path), as_column(kind)
    return F.when(kind == "image", F.concat(path, F.lit(".png"))).when(kind == "audio", F.concat(path, F.lit(".ogg"))).when(kind.isin("dsc", "compiled"), F.concat(path, F.lit(PROJECT_SUFFIX)))


def patched_name(path: Column | str) -> Column:
    return F.concat(as_column(path), F.lit(PATCHED_SUFFIX))


def encoded_image_name(path: Column | str) -> Column:
    """`<stem>.cbg` of a PNG file."""
    return F.concat(F.regexp_replace(as_column(path), r"\.[^./]*$", ""), F.lit(".cbg"))


def script_of_project(path: Column | str) -> Column:
    """The script's path of a project file; null where the suffix is missing."""
    path = as_column(path)
    return F.when(has_suffix(path, PROJECT_SUFFIX), F.regexp_replace(path, r"(?i)\.hazuki\.txt$", ""))


def unique_names(archives: DataFrame, path: str = "path") -> DataFrame:
    """archives with output_dir: the stem of each path, `stem_2`, `stem_3` ... in path order where it is taken.

    A generated name may itself be a later archive's stem. Only stems that are equal without their
    `_number` endings can meet, and only where a stem repeats are names generated, so a family of several
    stems, one of which repeats, is named by itself, in path order; all others, such as data_1 to data_n
    of any size, are named by windows alone.
    """
    stem = F.regexp_replace(F.regexp_replace(F.col(path), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    rows = archives.withColumn("stem", F.when(stem == "", "archive").otherwise(stem)).withColumn("family", F.regexp_replace("stem", r"(_\d+)+$", ""))
    family = Window.partitionBy("family")
    rows = rows.withColumn("again", F.count("*").over(Window.partitionBy("stem")))
    rows = rows.withColumn("mixed", (F.min("stem").over(family) != F.max("stem").over(family)) & (F.max("again").over(family) > 1)).drop("again")
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(path))
    plain = rows.where(~F.col("mixed")).withColumn("output_dir", F.when(rank == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", rank)))
    schema = rows.withColumn("output_dir", F.lit("")).schema

    def name(group: pd.DataFrame) -> pd.DataFrame:
        group, used, names, after = group.sort_values(path), set(), [], {}
        for stem in group["stem"]:
            pick, n = stem, after.get(stem, 2)
            while pick in used:
                pick, n = f"{stem}_{n}", n + 1
            after[stem] = n
            used.add(pick)
            names.append(pick)
        return group.assign(output_dir=names)

    mixed = rows.where("mixed").groupBy("family").applyInPandas(name, schema)
    return plain.unionByName(mixed).drop("stem", "family", "mixed")

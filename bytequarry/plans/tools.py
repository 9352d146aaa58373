"""Batch jobs over files (path string, content binary): texts out of scripts and back into them, images both ways, and any asset by its kind.

Each job gives a row a file: path, output_path, output, status (converted, skipped or error), error. With
fail_fast a file's error fails the query. Null content counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import image, png
from bytequarry.functions.binary import FILE_ERRORS
from bytequarry.functions.formats import IMAGE_MAGIC, PROJECT_SUFFIX
from bytequarry.operators import script
from bytequarry.operators.classify import audio_payload, classify, encoded_image_name, has_suffix, output_name, patched_name, script_of_project
from bytequarry.operators.script import script_entries
from bytequarry.sources import projects


def _with_status(rows: DataFrame, fail_fast: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """path, output_path, output, status, error (and more) of rows (path, output_path, output, error)."""
    error = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")) if fail_fast else F.col("error")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("output").isNotNull(), "converted").otherwise("skipped")
    return rows.select("path", *more, F.when(F.col("output").isNotNull(), F.col("output_path")).alias("output_path"), "output", status.alias("status"), error.alias("error"))


def _converted(rows: DataFrame, fn: Callable[[str, str, bytes], bytes | None], more: tuple[str, ...] = ()) -> DataFrame:
    """path, more strings, output_path, output and error of fn(job, path, content) for rows (path, content, job, output_path)."""
    names = ["path", "output_path", *more, "output", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a file at a time, so that no more than one is held twice
            for path, to, job, content, *own in zip(*(batch.column(c).to_pylist() for c in ("path", "output_path", "job")), batch.column("content"), *(batch.column(c).to_pylist() for c in more), strict=True):
                output, error = None, None
                try:
                    output = fn(job, path, content.as_py() or b"")
                except FILE_ERRORS as e:
                    error = str(e)
                strings = [pa.array([x], pa.string()) for x in (path, to, *own)]
                yield pa.RecordBatch.from_arrays([*strings, pa.array([output], pa.binary()), pa.array([error], pa.string())], names)

    schema = ", ".join(f"{n} {'binary' if n == 'output' else 'string'}" for n in names)
    return rows.select("path", "output_path", "job", "content", *more).mapInArrow(run, schema)


def extract_texts(scripts: DataFrame, page: int = 932, encode_page: int = 0, fail_fast: bool = False) -> DataFrame:
    """A text project of every script, compressed or not; encode_page 0: as the page that it is decoded by."""
    rows = scripts.select("path", "content", F.lit("extract").alias("job"), F.concat("path", F.lit(PROJECT_SUFFIX)).alias("output_path"))
    return _with_status(_converted(rows, lambda _, path, data: projects.script_text(path, *script_entries(data, page), page, encode_page or page)), fail_fast)


def apply_texts(scripts: DataFrame, files: DataFrame, page: int = 0, fail_fast: bool = False) -> DataFrame:
    """The patched script of every project in files; page 0: the page that the project names.

    A project's script is the one of its path without the suffix. A file without the suffix, one that is
    no project, or one whose script is missing is an error of its own; scripts without a project give no row.
    """
    named = files.select("path", script_of_project("path").alias("script"), "content")
    found = projects.parse(named.where(F.col("script").isNotNull()).select("script", "content"))
    own = scripts.select(F.col("path").alias("script"), "content")
    done = script.apply_project(own.join(named.select("script").distinct(), "script", "left_semi"), found, page)
    rows = named.select("path", "script").join(done, "script", "left").select(
        "path", patched_name("script").alias("output_path"), F.col("patched").alias("output"),
        F.when(F.col("script").isNull(), "not a project's name").when(F.col("patched").isNull(), F.coalesce("error", F.lit("the script is missing"))).alias("error"),
    )
    return _with_status(rows, fail_fast)


def _image(job: str, path: str, data: bytes) -> bytes | None:
    if job == "encode":
        return image.encode(png.load(data))
    return png.save(image.decode(data)) if job == "decode" else None


def convert_images(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """PNG files, by their extension, to images of the format, and those, by their first bytes, to PNG; other files are skipped."""
    is_png = has_suffix("path", ".png")
    job = F.when(is_png, "encode").when(F.startswith("content", F.lit(IMAGE_MAGIC)), "decode").otherwise("none")
    rows = files.select("path", "content", job.alias("job"), F.when(is_png, encoded_image_name("path")).otherwise(F.concat("path", F.lit(".png"))).alias("output_path"))
    return _with_status(_converted(rows, _image), fail_fast)


def _asset(job: str, path: str, data: bytes, page: int, encode_page: int) -> bytes | None:
    if job == "image":
        return png.save(image.decode(data))
    return projects.script_text(path, *script_entries(data, page), page, encode_page) if job in ("dsc", "compiled") else None


def convert_assets(files: DataFrame, page: int = 932, encode_page: int = 0, fail_fast: bool = False) -> DataFrame:
    """Loose files by their first bytes, whatever their names: images to PNG, scripts to text projects, audio to its payload; others are skipped.

    Also kind and label of every file. encode_page 0: as the page that a script is decoded by.
    """
    rows = classify(files.select("path", "content"))
    kinds = rows.select("path", "kind", "label", "content", F.col("kind").alias("job"), output_name("path", "kind").alias("output_path"))
    audio = kinds.where("kind = 'audio'").select("path", "kind", "label", "output_path", audio_payload("content").alias("a"))
    audio = audio.select("path", "kind", "label", "output_path", F.col("a.payload").alias("output"), F.col("a.error").alias("error"))
    others = _converted(kinds.where("kind <> 'audio'"), lambda job, path, data: _asset(job, path, data, page, encode_page or page), ("kind", "label"))
    return _with_status(others.unionByName(audio), fail_fast, ("kind", "label"))


def probe(files: DataFrame) -> DataFrame:
    """path, label, suggested_extension (empty where there is none) of files, from their first bytes alone."""
    return classify(files.select("path", "content")).select("path", "label", "suggested_extension")


def counted(done: DataFrame) -> DataFrame:
    """converted, skipped and failed files of a job."""
    return done.agg(*[F.count_if(F.col("status") == s).alias(name) for s, name in (("converted", "converted"), ("skipped", "skipped"), ("error", "failed"))])

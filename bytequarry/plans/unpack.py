"""The full unpack: archives -> entries -> kinds -> conversions -> summary, an error a column."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import dsc_many, image, jvm, png
from bytequarry.functions.binary import FILE_ERRORS
from bytequarry.operators.archive import extract_entries, guard_path, list_entries
from bytequarry.operators.classify import audio_payload, classify, output_name, unique_names
from bytequarry.operators.script import script_entries
from bytequarry.sources.projects import script_text


def convert(kind: str, path: str, data: bytes, page: int = 932, plain: bytes | None = None) -> bytes | None:
    """The converted bytes of an image or script; plain: the bytes of a compressed script or the pixels of an image, where they are known."""
    if kind == "image":
        return png.save(image.decode(data) if plain is None else image.of_pixels(data, plain))
    if kind in ("dsc", "compiled"):
        return script_text(path, *script_entries(data, page, plain), page)
    return None


def unpack(archives: DataFrame, page: int = 932, fail_fast: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """arc_path, output_dir, entry_index, path, kind, label, status, output_path, output, retained, error of every entry.

    archives: arc_path, content. status: converted, skipped (nothing to convert) or error. Work is dealt
    out by entry. Only images lose their source once converted. paths: the archives' arc_path, where they are known
    without making or reading the content.
    """
    names = unique_names((archives if paths is None else paths).select(F.col("arc_path").alias("path")).distinct()).withColumnRenamed("path", "arc_path")
    # an entry's conversion costs far more than its bytes: deal entries to all partitions, uncoalesced
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classify(extract_entries(archives, page, fail_fast).repartition(n, "arc_path", "entry_index"))
    rows = rows.withColumn("audio", audio_payload("content")).withColumn("read_error", F.col("error"))
    ready = jvm.column(archives.sparkSession, F.when(F.col("kind").isin("dsc", "image") & F.col("error").isNull(), F.col("kind")), "content")
    rows = rows.withColumn("ready", F.lit(None).cast("binary") if ready is None else ready)
    rows = rows.withColumn("content", F.when(F.col("kind").isin("image", "dsc", "compiled"), F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            held = [batch.column(c).to_pylist() for c in ("kind", "path", "content", "read_error")]
            ready = {i: made for i, made in enumerate(batch.column("ready").to_pylist()) if made is not None}
            packed = [i for i, (kind, error) in enumerate(zip(held[0], held[3], strict=True)) if kind == "dsc" and error is None and i not in ready]
            ready |= zip(packed, dsc_many.sound([held[2][i] for i in packed]), strict=True)
            for i, (kind, path, data, wrong) in enumerate(zip(*held, strict=True)):
                value, error = None, wrong
                if error is None:
                    try:
                        value = convert(kind, path, data, page, ready.pop(i, None))
                    except FILE_ERRORS as e:
                        if fail_fast:
                            raise
                        error = str(e)
                out.append(value)
                errors.append(error)
            keep = ["arc_path", "entry_index", "path", "kind", "label"]
            audio = batch.column("audio")
            payload, wrong = audio.field("payload").to_pylist(), audio.field("error").to_pylist()
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == "audio" and errors[i] is None:
                    out[i], errors[i] = payload[i], wrong[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [*keep, "output", "error"])

    done = rows.select("arc_path", "entry_index", "path", "kind", "label", "content", "ready", "audio", "read_error").mapInArrow(
        run, "arc_path string, entry_index int, path string, kind string, label string, output binary, error string"
    )
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("output").isNotNull(), "converted").otherwise("skipped")
    done = done.withColumn("status", status).join(names, "arc_path", "left")
    return done.select(
        "arc_path", "output_dir", "entry_index", "path", "kind", "label", "status", F.when(F.col("status") == "converted", output_name("path", "kind")).alias("output_path"),
        "output", ((F.col("status") != "converted") | (F.col("kind") != "image")).alias("retained"), "error",
    )


def work(archives: DataFrame) -> DataFrame:
    """archives, total_entries, total_bytes and total_work (two steps an entry) before a run, from the directories alone."""
    found = list_entries(archives).where("entry_index IS NOT NULL").select(F.lit(None).cast("string").alias("arc_path"), F.lit(1).alias("entry"), "size")
    own = archives.select("arc_path", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("size"))
    return found.unionByName(own).agg(
        F.count_distinct("arc_path").alias("archives"), F.count_if(F.col("entry") == 1).alias("total_entries"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), (F.count_if(F.col("entry") == 1) * 2).alias("total_work"),
    )


def summary(unpacked: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """archives, extracted, processed, converted, skipped; an entry in error counts as skipped.

    archives: the run's own archives (arc_path, content); those that can be read are counted, without
    entries too. Without it, those that have an entry are.
    """
    whole = F.col("entry_index").isNotNull()
    rows = unpacked.select("arc_path", F.when(whole, "entry").otherwise("bad").alias("is"), "status")
    if archives is not None:
        rows = rows.unionByName(archives.select("arc_path", F.lit("archive").alias("is"), F.lit(None).cast("string").alias("status")))
    of = lambda kind: F.count_distinct(F.when(F.col("is") == kind, F.col("arc_path")))
    entry, converted = F.col("is") == "entry", F.col("status") == "converted"
    return rows.agg(
        (of("entry") if archives is None else of("archive") - of("bad")).alias("archives"), F.count_if(entry).alias("extracted"), F.count_if(entry).alias("processed"),
        F.count_if(entry & converted).alias("converted"), F.count_if(entry & ~converted).alias("skipped"),
    )


def write_outputs(unpacked: DataFrame, folder: str) -> DataFrame:
    """The converted files as Parquet below a folder that this call overwrites: output_dir, output_path, output; returns the table read back."""
    rows = unpacked.where("status = 'converted'").select("output_dir", "output_path", "output")
    rows.write.mode("overwrite").parquet(folder)
    return unpacked.sparkSession.read.schema(rows.schema).parquet(folder)


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Each row's content as a file of its own below a folder that this call empties first; returns path, bytes, error of each.

    Parents are created. What is returned is read from the list of files in the folder's `_files` (Parquet). The folder is a path or URI of any file system that pyarrow opens and all executors
    share. A file is written under a name of the attempt's own and then moved, so that a task that is run
    again leaves whole files only. Of rows of one path, one stays. A null content or path is no file; a path
    that the guard refuses is a row of its error.
    """
    folder = folder if "://" in folder else "file://" + os.path.abspath(folder)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    store.delete_dir_contents(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for name, wrong, data in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist(), batch.column("content"), strict=True):
                value, error = data.as_py(), wrong
                if error is None:
                    to = f"{base}/{name}"
                    try:
                        store.create_dir(os.path.dirname(to), recursive=True)
                        part = f"{to}.{uuid.uuid4().hex}.part"
                        with store.open_output_stream(part) as out:
                            out.write(value)
                        store.move(part, to)
                    except OSError as e:
                        error = str(e)
                done.append((name, None if error else len(value), error))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "bytes", "error"])

    safe = guard_path(path)
    found = rows.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.coalesce(safe.path, path).alias("path"), F.col(content).alias("content"), safe.error.alias("error"))
    written = found.mapInArrow(run, "path string, bytes long, error string")
    written.write.parquet(f"{folder}/_files")
    return rows.sparkSession.read.schema(written.schema).parquet(f"{folder}/_files")


def write_unpacked(archives: DataFrame, folder: str, page: int = 932, fail_fast: bool = False) -> DataFrame:
    """The whole unpack into a folder: every retained entry and every converted file below its archive's own folder; what write_files says of each.

    The sources of converted images are not kept.
    """
    done = unpack(archives, page, fail_fast)
    names = done.where("entry_index IS NOT NULL").select("arc_path", "entry_index", "output_dir", "retained")
    own = extract_entries(archives, page).where("error IS NULL").select("arc_path", "entry_index", "path", "content").join(names.where("retained"), ["arc_path", "entry_index"])
    files = own.select(F.concat_ws("/", "output_dir", "path").alias("path"), "content")
    made = done.where("status = 'converted'").select(F.concat_ws("/", "output_dir", "output_path").alias("path"), F.col("output").alias("content"))
    return write_files(files.unionByName(made), folder)

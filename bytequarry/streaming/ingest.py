"""Continuous ingest: every operator on files is stateless, so a stream of files is classified as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytequarry.operators.classify import classify

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def classified_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """path, length, kind, label, suggested_extension of files as they arrive below a folder."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return classify(reader.load(folder)).select("path", "length", "kind", "label", "suggested_extension")

"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import bpe, bpe_sql, langid, langid_sql, linededup, media, packing, planes, simhash, simhash_sql, spotsigs, toxicity, urlcascade
from bytequarry.llm.common import bounded_batches
from bytequarry.llm.common import table as read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(bounded_batches(spark), sf_dir, name)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlcascade.judge(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return planes.read(planes.write(docs, planes.encode(docs)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.drop(docs, linededup.settle(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.through_images(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spotsigs": spotsigs.ORACLE, "op2_url_cascade": urlcascade.ORACLE, "op3_language": langid_sql.oracle(), "op4_planes": bpe_sql.shards(),
        "op5_line_dedup": linededup.ORACLE, "op7_bpe": bpe_sql.round_trip(), "op8_simhash": simhash_sql.oracle(),
    }

"""The corpus pipeline: documents of a known language, not toxic, without common lines, one of each near-duplicate group, packed.

Each stage works on all rows that the one before it kept; it is written as Parquet and read again.

Defined results: documents without a letter (null and empty texts too) have no language and go; of rows that repeat
and of near duplicates the one of the smallest doc_id stays, and every row without a doc_id; texts of any length pass
whole; without labels no document is toxic; columns beside doc_id and text pass the first four stages as they are,
whatever their names (n_chars is renewed); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytequarry.llm import langid, linededup, packing, simhash_wide, toxicity
from bytequarry.llm.common import bounded_batches, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; `und` and those under the least score go."""
    return langid.known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labels of rows that are not held out."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them share; n_chars counts what is left."""
    return linededup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return simhash_wide.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("best-fit packing", pack),
]

#: SQL expresses neither the learned stages nor SimHash; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bounded_batches(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

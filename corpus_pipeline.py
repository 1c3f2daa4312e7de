"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the input of the next.

Every stage takes (spark, docs, sf_dir) and judges its own input, all of it. All but the last return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runtally.llm import language, line_winnow, minhash, packing, secret_scan
from runtally.llm.rows import remainder, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries learned from the labelled ones can tell; the others go."""
    return language.keep_known(docs, language.learn(docs, remainder(F.col("doc_id"), 4) >= 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents that hold nothing else."""
    return line_winnow.delete_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, at a similarity of 0.8 or more."""
    return minhash.keep_first(docs, percent=80)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secret_masking),
    ("packing", sequence_packing),
]

#: Compression, estimates of randomness and packing are not for SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Training text from documents: toxicity, near copies, benchmark leaks, personal data, tokens.

    run(spark, folder)       all stages over `documents` in the folder
    STAGES                   (name, function of spark, documents and folder)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from saleslens.llm import byte_pairs, decontamination, near_copies, personal_data, toxicity
from saleslens.operators.staging import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, folder, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, 80 percent in common."""
    return near_copies.drop_near_copies(docs, near_copies.NearCopyRule(words=5, percent=80))


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, _table(spark, folder, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; every document stays."""
    return personal_data.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document (decimal, joined by commas), and whether they decode to its text."""
    coded = byte_pairs.encode_documents(docs, byte_pairs.installed_vocabulary())
    exact = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", exact)


STAGES = [
    ("toxicity", not_toxic),
    ("near_copies", without_near_copies),
    ("decontamination", without_leaks),
    ("personal_data", without_personal_data),
    ("byte_pairs", tokens),
]

#: FTRL, MinHash and alignment have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again; the last one's rows."""
    docs = _table(spark, folder, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, folder), name)
    return docs

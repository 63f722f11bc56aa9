"""The corpus pipeline: language ID, near-dedup, personal data, mixing, BPE.

``STAGES`` lists ``(name, function)``; each function takes
``(spark, docs, sf_dir)`` and works on all its predecessor kept.  All but the
last return the columns of ``documents``.  ``run`` writes each stage's result
as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, langid, mixing, pii, simhash
from lorekeep.llm.common import saved, work_folder
from lorekeep.llm.queries import vocabulary_path
from lorekeep.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the network learns from the labelled documents that are not held out."""
    ship(spark)
    return langid.keep_identified(docs, langid.learn(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates."""
    ship(spark)
    return simhash.near_duplicates_removed(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a placeholder that names its kind; ``n_chars`` follows the text."""
    ship(spark)
    clean = pii.redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as many times as whole copies of it are taken; the copy at which the budget is spent stays whole."""
    ship(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded text."""
    ship(spark)
    return bpe.encode_documents(docs, vocabulary_path(), digests=True)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mixed), ("bpe", tokens)]

#: SQL cannot train a network or merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs

"""The benchmark queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, bwt, langid, lm, media, mixing, phrases, pii, quality, simhash

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    """The public vocabulary file; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path(), ids=False, digests=True)


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated_phrases(documents(spark, sf_dir), digest=True)


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no images, so each row of ``embeddings`` is drawn as one, every fourth with two edited copies."""
    ship(spark)
    return media.image_copies(media.media_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_later_substrings(documents(spark, sf_dir), digest=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_repeated_phrases": op2_repeated_phrases,
        "op3_image_copies": op3_image_copies,
        "op4_pii": op4_pii,
        "op5_mixing": op5_mixing,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_simhash": op7_simhash,
        "op8_lm_score": op8_lm_score,
        "op9_quality": op9_quality,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality": quality.ORACLE_SQL}

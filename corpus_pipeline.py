"""A training corpus in five stages, each a DataFrame operator over what its predecessor kept.

Every stage but the last returns the columns of documents. Nothing is dropped but texts without a letter, copies and
near copies of a document that stays, and documents contaminated by the benchmark; personal data is replaced in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import decontam, language, near_dup, pii, sentencepiece_codec
from passagemill.llm.components import saved, text_batches
from passagemill.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that the labels teach go."""
    text_batches(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    said = language.identify(docs, model, labels=("lang_said", "lang_score"))
    return said.where(F.col("lang_said") != language.UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    text_batches(spark)
    return near_dup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    text_batches(spark)
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), how="documents")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    text_batches(spark)
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, and whether the text comes back from them."""
    text_batches(spark)
    return sentencepiece_codec.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"], round_trip="round_trip")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("personal_data", personal_data), ("sentencepiece", sentencepiece)]

#: SQL can't express the language model, the contextual patterns or the Viterbi.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

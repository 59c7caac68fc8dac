"""A training-data pipeline over the documents table, stage by stage.

Every stage takes the documents its predecessor kept and returns those it keeps, with the
columns of the table; the last one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import decontaminate, language_crf, minhash_dedup, piece_codec, quality_mil
from locusflow.llm.text import stored, table

#: A text whose words are labelled less surely than this on average is rejected, however many languages it mixes.
LEAST_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter and words whose languages are sure."""
    labelled = language_crf.with_language(docs, language_crf.training_model(docs))
    sure = (F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("lang_certainty") >= LEAST_LANGUAGE_SCORE)
    return labelled.where(sure).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier accepts."""
    model = quality_mil.training_model(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.with_quality(docs, model)
    return scored.where(F.col("quality_score") >= quality_mil.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return minhash_dedup.without_duplicates(docs).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return piece_codec.encode_texts(docs, piece_codec.load()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("sentencepiece", tokens),
]

#: Trained models decide in two stages, so no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all stages; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

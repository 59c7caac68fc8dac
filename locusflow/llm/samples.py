"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts longer than this are not picked for fitting, so a sample's bytes are bounded too.
SAMPLE_CHARS = 20_000


def labelled_texts(documents: DataFrame, labels: DataFrame, each: int, longest: int = SAMPLE_CHARS) -> pd.DataFrame:
    """(label, text) of at most ``each`` documents of every label, picked by a hash of their id.

    ``labels`` has (doc_id, label). Ids are picked first, so only they travel and only
    their texts reach the driver: at most ``each`` texts of ``longest`` characters a label.
    An id with several labels takes its smallest.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    one = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    picked = (
        one.groupBy("doc_id").agg(F.min("label").alias("label"))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= each)
        .select("doc_id", "label")
    )
    texts = documents.where(F.char_length("text").between(1, longest)).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), "doc_id").select("label", "text", "doc_id").toPandas()
    return found.sort_values(["doc_id", "text"]).drop_duplicates("doc_id").reset_index(drop=True)

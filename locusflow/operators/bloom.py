"""Bloom filters as ordinary frames: one 64-bit word for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a filter at most: 2**26 bits, about 24 MB when broadcast, whatever the keys' number.
MOST_WORDS = 1 << 20
#: Keys meant for a word, and bits a key sets in it: about one false positive in a hundred.
KEYS_PER_WORD, BITS = 4, 3
#: Stores below so many bytes, as the planner knows them, are joined as they are.
WORTHWHILE_BYTES = 256 << 20


def _word_and_mask(keys: list[str], words: int) -> tuple[Column, Column]:
    """Which word a key falls into, and its bits there; both from one hash."""
    h = F.xxhash64(*keys)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.call_function("shiftrightunsigned", h, F.lit(40 + 7 * i)).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return h.bitwiseAND(F.lit(words - 1)), mask


def word_count(keys: int) -> int:
    """A power of two that gives every word few keys, MOST_WORDS at most."""
    return min(MOST_WORDS, 1 << max(4, (max(1, keys) // KEYS_PER_WORD).bit_length()))


def bloom_filter(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(word, bits) of the keys of ``rows``; combined before the shuffle, at most ``words`` rows."""
    word, mask = _word_and_mask(keys, words)
    return rows.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def pruned(store: DataFrame, rows: DataFrame, keys: list[str], least_bytes: int = WORTHWHILE_BYTES) -> DataFrame:
    """The store without most rows whose keys do not occur in ``rows``; never without one whose keys do.

    Meant before a shuffle of the store: the filter is broadcast (MOST_WORDS rows at most) and tested in the
    scan's stage. ``rows`` is read twice, so it should be written already. Small stores
    are returned as they are. Rows with a NULL key match nothing and may go.
    """
    if planned_bytes(store) < least_bytes:
        return store
    words = word_count(rows.count())
    word, mask = _word_and_mask(keys, words)
    marked = store.withColumns({"_word": word, "_mask": mask})
    bits = bloom_filter(rows, keys, words).select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    kept = marked.join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return kept.drop("_word", "_mask", "_bits")


def planned_bytes(df: DataFrame) -> int:
    """Bytes of the frame as the planner estimates them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

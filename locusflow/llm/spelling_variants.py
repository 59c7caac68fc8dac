"""Spelling variants: words one edit apart, tied to their much more frequent form.

Two words are one inserted, deleted or replaced letter apart exactly when their common
prefix and common suffix together reach the longer length less one. Then one of the two
reaches half of that, so with M the longer length a near pair shares its first or its last
M // 2 letters. Every word is posted under those halves, for its own length and for the next;
pairs are compared in dense tiles of posted words: two padded matrices of code points, the
words written forwards and backwards, give the prefix and suffix lengths of all pairs of the
tile. A tile has a bounded number of rows: halves are hashed into buckets, and a bucket with
more rows becomes all pairs of its blocks. A tile returns sums and the best word for each
of its words, never its pairs; each pair is counted under its first half if that is
shared, else under its last.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.text import ascii_lower
from locusflow.operators.durable import durable

#: A word counts from so many code points and occurrences on.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
RATIO = 5
#: Rows of a block, and code points of its matrices if the words are long.
BLOCK_ROWS, BLOCK_CELLS, FEWEST_ROWS = 512, 1 << 20, 8

#: Postings of a word, and posted rows for a task.
POSTINGS, TASK_ROWS = 4, 20_000

TILE = ["kind", "longer", "bucket", "low", "high"]
FOUND = "word string, n_near bigint, best_n bigint, best string"


def word_runs(documents: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, word): every run of at least ``least`` Latin letters, with A-Z lower-cased. A null text has none."""
    letters = F.lit(f"[{string.ascii_lowercase[0]}-{string.ascii_lowercase[-1]}À-ÿ]{{{least},}}")
    found = F.regexp_extract_all(ascii_lower(F.col("text")), letters, F.lit(0))
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.explode(found).alias("word"))


def with_slips(words: DataFrame, every: int = 199) -> DataFrame:
    """The words with one letter lost where ``every`` divides h = crc32('<doc_id>:<word>'): that at h % length.

    A null id is written as the empty text.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    marked = words.withColumn("_h", F.crc32(key.cast("binary")))
    at = F.expr("cast(_h % char_length(word) AS INT)")
    short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return marked.select("doc_id", F.when(F.col("_h") % every == 0, short).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least`` code points and ``count`` occurrences."""
    long = words.where(F.char_length("word") >= least)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _agreement(x: list[str], y: list[str], width: int) -> np.ndarray:
    """Common prefix lengths of all pairs, from padded code-point matrices."""
    a, b = (np.array(w, dtype=f"U{width}").view(np.uint32).reshape(len(w), width) for w in (x, y))
    equal = np.ones((len(x), len(y)), dtype=bool)
    length = np.zeros((len(x), len(y)), dtype=np.int32)
    for c in range(width):
        # Padding equals padding only behind the end of both, where equal words alone arrive.
        equal &= a[:, c][:, None] == b[:, c][None, :]
        if not equal.any():
            break
        length += equal
    return length


def _best(near: np.ndarray, words: np.ndarray, count: np.ndarray, other_words: np.ndarray, other_count: np.ndarray) -> pd.DataFrame:
    """For every word with near words: how many, and the most frequent of them, the smallest if several."""
    rank = np.lexsort((other_words, -other_count))
    some = near.any(axis=1)
    first = rank[np.argmax(near[:, rank], axis=1)][some]
    return pd.DataFrame(
        {"word": words[some], "n_near": near[some].sum(axis=1), "best_n": other_count[first], "best": other_words[first]}
    )


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    kind, longer, _, low, high = key
    width, half = int(longer), int(longer) // 2
    sides = [rows[rows["block"] == b].reset_index(drop=True) for b in ((low,) if low == high else (low, high))]
    one, two = sides[0], sides[-1]
    a, b = one["word"].tolist(), two["word"].tolist()
    prefix = _agreement(a, b, width)
    suffix = _agreement([w[::-1] for w in a], [w[::-1] for w in b], width)
    size_a, size_b = (np.array([len(w) for w in x]) for x in (a, b))
    most = np.maximum(size_a[:, None], size_b[None, :])
    near = (prefix + suffix >= most - 1) & (most == width)
    # The shared half makes it a pair of this kind; equal words are the same word.
    near &= (prefix >= half) if kind == "first" else (suffix >= half) & (prefix < half)
    near &= ~((prefix == most) & (size_a[:, None] == size_b[None, :]))
    words_a, words_b = (np.array(w, dtype=object) for w in (a, b))
    out = [_best(near, words_a, one["n"].to_numpy(), words_b, two["n"].to_numpy())]
    if low != high:
        out.append(_best(near.T, words_b, two["n"].to_numpy(), words_a, one["n"].to_numpy()))
    return pd.concat(out)


def tiles(words: DataFrame, n_words: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Posted words with their tile; a word stands once in every tile of its block and bucket."""
    half = F.expr("longer div 2")
    posted = (
        words.withColumn("longer", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)))
        .withColumn("kind", F.explode(F.array(F.lit("first"), F.lit("last"))))
        .withColumn("_half", F.when(F.col("kind") == "first", F.left("word", half)).otherwise(F.right("word", half)))
        .withColumn("bucket", F.pmod(F.xxhash64("_half"), F.lit(max(1, n_words // block))))
        .drop("_half")
    )
    own = F.greatest(F.lit(FEWEST_ROWS), F.least(F.lit(block), F.expr(f"{BLOCK_CELLS} div longer")))
    bucket = ["kind", "longer", "bucket"]
    # Buckets without a word of the longer length, or with one word, have no pair.
    counts = posted.groupBy(*bucket).agg(
        F.count("*").alias("rows"), F.count_if(F.char_length("word") == F.col("longer")).alias("long")
    ).where("rows > 1 AND long > 0")
    sized = counts.withColumn("blocks", F.ceil(F.col("rows") / own)).select(*bucket, "blocks")
    mine = F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).alias("block")
    dealt = posted.join(sized, bucket).select("word", "n", *bucket, mine, "blocks")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("_other", others).select(
        "word", "n", *bucket, "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")
    )


def near_words(words: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have words one edit apart."""
    n_words = words.count()
    # Tiles are few bytes and much work, so tasks are made by rows: planned by bytes they would be too few.
    tasks = max(1, POSTINGS * n_words // TASK_ROWS)
    dealt = tiles(words, n_words, block).repartition(tasks, *TILE)
    parts = dealt.groupBy(*TILE).applyInPandas(_tile, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return summed.select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. Every round doubles the step; forms grow, so none returns."""
    held = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = durable(held.join(ahead, "root", "left"))
        held = further.select("word", F.coalesce("_next", "root").alias("root"))
        if further.where(F.col("_next").isNotNull()).isEmpty():
            return held


def spelling_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n).

    ``words`` has distinct words without null; rows with a null word or count are left out, other columns too. ``form`` is the most
    frequent word one edit apart (ties: the smallest in code-point order) if it is at least
    ``ratio`` (2 or more) times as frequent, else null; ``root`` is the last of the forms'
    chain, the word itself if it has no form. An empty table gives none. ``block`` bounds a tile's rows
    and changes no result.
    """
    words = durable(words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    found = words.join(near_words(words, block), "word", "left")
    chosen = F.col("best_n") >= ratio * F.col("n")
    found = durable(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

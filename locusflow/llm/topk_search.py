"""Exact top-k inner product search by Fagin's threshold algorithm.

Vectors are dealt into blocks. In a block every dimension has a list sorted by value; a
query walks each list from the end that its own component favours. Each round reads the
next stretch of all lists, scores the vectors seen for the first time, and bounds every
unseen vector by the sum of the products at the current depth. A query stops when that
bound is below its k-th score, so equal scores are still seen and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of a block of queries: the size of the groups that tasks work on.
BLOCK_ROWS, QUERY_ROWS = 2048, 1024
FIRST_DEPTH = 32
SCORED = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components floor(scale * x). Vectors that are null or hold null or non-finite components go."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    clean = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return clean.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", odd)).select(
        "vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x)).alias("v")
    )


def threshold_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query position, vector position, score) of each query's k best rows of ``x``, its own id left out.

    Integers are exact in float64 below 2**53; larger bounds use 64-bit integers.
    """
    n, dims = x.shape
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dims, 1)
    kind = np.float64 if largest < 2**53 else np.int64
    x, q = x.astype(kind), q.astype(kind)
    order = np.argsort(x, axis=0, kind="stable")  # ascending in each dimension
    ranked = np.take_along_axis(x, order, axis=0)
    seen = np.zeros((len(q), n), dtype=bool)
    scores = np.full((len(q), n), np.iinfo(np.int64).min, dtype=np.int64)
    kth = np.full(len(q), -np.inf)
    active, low, depth = np.arange(len(q)), 0, FIRST_DEPTH
    while len(active) and low < n:
        high = min(low + depth, n)
        fresh = np.zeros((len(active), n), dtype=bool)
        for d in range(dims):
            up = q[active, d] < 0  # small values are the good ones
            fresh[np.ix_(~up, order[n - high : n - low, d])] = True
            fresh[np.ix_(up, order[low:high, d])] = True
        if dims == 0:
            fresh[:] = True
        fresh &= ~seen[active]
        seen[active] |= fresh
        for row, new in zip(active, fresh):
            at = np.flatnonzero(new)
            if len(at):
                scores[row, at] = (x[at] @ q[row]).astype(np.int64)
            own = seen[row] & (ids != query_ids[row])
            if own.sum() >= k:
                kth[row] = np.partition(scores[row, own], -k)[-k]
        edge = np.where(q[active] < 0, ranked[high - 1], ranked[n - high])
        bound = (edge * q[active]).sum(axis=1)
        active = active[bound >= kth[active]]
        low, depth = high, depth * 2
    for row in range(len(q)):
        at = np.flatnonzero(seen[row] & (ids != query_ids[row]))
        best = at[np.lexsort((ids[at], -scores[row, at]))[:k]]
        for b in best:
            yield row, b, scores[row, b]


def _blocks(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            x, q = (np.array(f["v"].tolist(), dtype=np.int64).reshape(len(f), -1) for f in (vectors, queries))
            ids, query_ids = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            out = [(query_ids[r], ids[b], s) for r, b, s in threshold_search(ids, x, query_ids, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k highest scores: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have (vec_id, v). Vectors of another length than the query's
    are no candidates; a query without candidates has no row; repeated rows of one id count
    once if equal and are searched separately if not. Both sides are dealt into blocks of
    bounded size and every pair of blocks is one group, so no task or driver holds a whole side.
    """
    vectors = vectors.select("vec_id", "v", F.size("v").alias("dims")).distinct()
    queries = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dims")).distinct()
    n, m = vectors.count(), queries.count()
    n_blocks, m_blocks = -(-n // BLOCK_ROWS) or 1, -(-m // QUERY_ROWS) or 1
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda of, name: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    left = vectors.withColumn("block", dealt(n_blocks, "vec_id")).withColumn("query_block", every(m_blocks))
    right = queries.withColumn("query_block", dealt(m_blocks, "query_id")).withColumn("block", every(n_blocks))
    keys = ["dims", "block", "query_block"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_blocks(k), SCORED)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )

"""Exact positions inside groups of any size, and top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.durable import stored

TASK_BITS = 33


def position_in_group(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position of each row in its group, without holding a group in one task.

    The frame is range-partitioned on group and order, so a large group covers several
    tasks. Each (group, task) run is counted, runs get start offsets, and a row's
    position is its run's offset plus its place in the run. The sorted frame is
    written because range boundaries are sampled anew on every evaluation.
    """
    keys = [F.col(g) for g in group]
    at = F.monotonically_increasing_id()
    placed = stored(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", at)
    ).withColumn("_task", F.shiftright("_at", TASK_BITS))
    runs = placed.groupBy(*group, "_task").agg(
        F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n")
    )
    # One row per task at most inside a group, so this window stays as small as the cluster.
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = F.col("p._task") == F.col("o._task")
    for g in group:
        same = same & F.col(f"p.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = placed.alias("p").join(offsets.alias("o"), same, "inner")
    return joined.select(
        *[F.col(f"p.{c}") for c in df.columns],
        (F.col("o._offset") + F.col("p._at") - F.col("o._start") + 1).alias(name),
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark trims each task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; combines before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])

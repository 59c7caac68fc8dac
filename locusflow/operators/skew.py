"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators.durable import durable

SPREAD = "_spread"
# A key is heavy with HEAVY_FLOOR rows and 1/HEAVY_SHARE of all rows. The sketch tracks
# TRACKED keys and overstates a count by at most 3.5/65536 of all rows, so it lists every
# heavy key, and of the others only such with 1/HEAVY_SHARE - 1/18724 of the rows: fewer
# than LISTED in all. These are bounds on any data, not limits on what is treated.
HEAVY_FLOOR = 100_000
HEAVY_SHARE = 4096
TRACKED, LISTED = 1 << 15, 1 << 13
SKETCH_GROUPS = 64
FAN_OUT = 1 << 20
#: Tables up to so many bytes, as measured, go to every executor.
BROADCAST_BYTES = 64 << 20


def heavy_hashes(df: DataFrame, keys: list[str], floor: int = HEAVY_FLOOR) -> list[int]:
    """Hashes of the keys to spread."""
    return counted_heavy_hashes(df, keys, floor)[0]


def counted_heavy_hashes(df: DataFrame, keys: list[str], floor: int = HEAVY_FLOOR) -> tuple[list[int], int]:
    """Hashes of the keys to spread, from mergeable heavy-hitter sketches, and the number of rows.

    One narrow pass reads the key columns: every task sends one sketch of fixed size, and
    sketches are merged in two steps. Keys that share a heavy key's hash are spread with
    it, which changes no result.
    """
    hashed = df.select(F.xxhash64(*keys).alias("_key"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_g"))
    parts = hashed.groupBy("_g").agg(
        F.expr(f"approx_top_k_accumulate(_key, {TRACKED})").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    merged = parts.groupBy(F.lit("all").alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {TRACKED})").alias("_s"), F.sum("_n").alias("_n"))
    found = merged.select("_n", F.expr(f"approx_top_k_estimate(_s, {LISTED})").alias("_top")).first()
    if found is None:
        return [], 0
    return [x["item"] for x in found["_top"] if x["count"] >= max(floor, found["_n"] / HEAVY_SHARE)], found["_n"]


def spread_number(keys: list[str], heavy: list[int], spread_on: list[str], fan: int = FAN_OUT) -> Column:
    """0 for ordinary keys; heavy keys and those with a NULL get a number from 1 to ``fan`` that differs by row."""
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    number = (F.pmod(F.xxhash64(*spread_on), F.lit(fan)) + 1).cast("int")
    return F.when(no_key | F.xxhash64(*keys).isin(heavy), number).otherwise(F.lit(0))


def heavy_rows(table: DataFrame, keys: list[str], heavy: list[int]) -> DataFrame:
    """The keys and ``_hot``, the other columns, of the rows whose key is heavy; for a broadcast.

    ``table`` has one row per key, so these are at most about LISTED rows.
    """
    values = F.struct(F.lit(True).alias("_held"), *[c for c in table.columns if c not in keys])
    return F.broadcast(table.where(F.xxhash64(*keys).isin(heavy)).select(*keys, values.alias("_hot")))


def lookup(
    df: DataFrame, table: DataFrame, keys: list[str], spread_on: list[str], floor: int = HEAVY_FLOOR, fan: int = FAN_OUT
) -> DataFrame:
    """Left join to a table with one row per key.

    Rows of heavy keys are dealt evenly over the join's tasks, where they meet no row of
    the table; they take their values from the few broadcast rows of those keys.
    """
    heavy = heavy_hashes(df, keys, floor)
    if not heavy:
        return df.join(table, keys, "left")
    values = [c for c in table.columns if c not in keys]
    placed = df.withColumn(SPREAD, spread_number(keys, heavy, spread_on, fan))
    cold = table.withColumn(SPREAD, F.lit(0))
    joined = placed.join(cold, [*keys, SPREAD], "left").join(heavy_rows(table, keys, heavy), keys, "left")
    chosen = [F.when(F.col(SPREAD) > 0, F.col(f"_hot.{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*df.columns, *chosen)


def attach(df: DataFrame, table: DataFrame, keys: list[str], spread_on: list[str], most: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of wide rows to a small table with one row per key, if possible without moving them.

    The table is written first and its bytes are counted: up to ``most`` it is broadcast,
    beyond that the rows are moved as in ``lookup``.
    """
    table = durable(table)
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in table.columns), F.lit(0))
    if (table.agg(F.sum(width)).first()[0] or 0) <= most:
        return df.join(F.broadcast(table), keys, "left")
    return lookup(df, table, keys, spread_on)

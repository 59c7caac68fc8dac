"""Contiguous shards of near equal bytes, by global prefix sums of sizes.

Rows are put in one order: ranges by key over the partitions, sorted inside each. The
ordered rows are written once, so every later pass sees the same partitions whatever
executor reads them. A first pass sums bytes and rows of each partition; the running sums
over those few totals are where each partition begins. A second pass adds them up row by
row inside the partitions: no shuffle, one carried number. A row goes to the shard in which
its middle byte falls when the whole is cut at equal targets, which puts every cut at the
row boundary that is nearest to it. So a shard differs from its target by less than its
two rows at the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.durable import durable

#: Bytes counted for a document besides its text.
ROW_BYTES = 16
OWN = ["_size", "_bytes_before", "_rows_before", "_all_bytes"]


def sized(documents: DataFrame) -> DataFrame:
    """The documents with ``size``: the text's UTF-8 bytes, none for null, and ROW_BYTES."""
    return documents.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long"))


def _ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in order over numbered partitions; rows with equal keys may be dealt to several."""
    kept = rows.withColumn("_tie", F.monotonically_increasing_id())
    kept = kept.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return durable(kept).withColumn("_part", F.spark_partition_id())


def _begins(ordered: DataFrame) -> DataFrame:
    """One row a partition: bytes and rows of all partitions before it, and all bytes."""
    totals = ordered.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("_all_bytes"),
    )


def _place(shards: int):
    """Adds shard and position to the rows of one partition, batch by batch."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_so_far = rows_so_far = 0
        for batch in batches:
            size, begin, row, whole = (batch.column(c).to_numpy() for c in OWN)
            before = begin + bytes_so_far + np.cumsum(size) - size
            shard = (2 * before + size) * shards // np.maximum(2 * whole, 1)
            position = row + rows_so_far + np.arange(len(size))
            bytes_so_far += int(size.sum())
            rows_so_far += len(size)
            kept = [i for i, name in enumerate(batch.schema.names) if name not in OWN]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(np.minimum(shard, shards - 1), pa.int32()), pa.array(position, pa.int64())],
                names=[*(batch.schema.names[i] for i in kept), "shard", "_position"],
            )

    return place


def balanced_shards(rows: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard's order).

    ``size`` names a column of sizes (null or negative: 0; together below 2**62 / ``shards``).
    Rows follow the ``order`` columns, nulls first; rows that tie stand in any order and may be cut apart,
    so one key with any share of all rows is no single task. Shards are contiguous in that
    order and differ from the equal target by less than the two rows at their cuts; a row
    larger than a target leaves its neighbours empty. Columns named ``shard`` or ``slot`` are replaced. An
    empty table gives none.
    """
    rows = rows.drop("shard", "slot").withColumn("_size", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long"))
    ordered = _ordered(rows, order)
    begins = durable(_begins(ordered))

    def placed(of: DataFrame) -> DataFrame:
        # One row for each partition: its size is the number of partitions.
        known = of.join(F.broadcast(begins), "_part").drop("_part")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name not in OWN)
        return known.mapInArrow(_place(shards), ", ".join(filter(None, [schema, "shard int, _position bigint"])))

    first = placed(ordered.select("_part", "_size")).groupBy("shard").agg(F.min("_position").alias("_first"))
    out = placed(ordered).join(F.broadcast(first), "shard")  # a row for each shard
    return out.select(*rows.drop("_size").columns, "shard", (F.col("_position") - F.col("_first")).alias("slot"))


def shard_report(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by doc_id, then text checksum.

    The texts stay where they are: only ids, sizes and checksums are ordered. A null text
    has no bytes and the checksum of the empty text; null and repeated ids keep all their
    rows. Cuts depend on all sizes, so no ``grown_shard`` is promised (null).
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = sized(documents.select("doc_id", "text")).select("doc_id", "size", F.crc32(text).alias("text_crc32"))
    # Written first: ordering by ranges reads its input twice.
    dealt = balanced_shards(durable(rows), "size", ["doc_id", "text_crc32", "size"], shards)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = 40) -> None:
    """Parquet under ``path``/shard=N with all columns and ``slot``; a task writes the few shards its range meets.

    Whole rows are ordered by doc_id, then text checksum, as in ``shard_report``.
    """
    order = {"_text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}
    rows = sized(documents).withColumns(order)
    balanced_shards(rows, "size", ["doc_id", "_text_crc32", "size"], shards).drop("_text_crc32").write.partitionBy("shard").parquet(path)

"""Text lines with their file and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_BITS = (1 << 33) - 1


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line_no, value`` for plain or gzip text, with carriage returns removed.

    ``line_no`` is the start offset of the file split plus the row's index in its task.
    A task never holds more bytes than one split, so the number grows along each file
    without any global numbering pass.
    """
    raw = spark.read.text(paths if isinstance(paths, list) else [paths])
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        (
            F.col("_metadata.file_block_start")
            + F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
        ).alias("line_no"),
        F.regexp_replace("value", "\r+$", "").alias("value"),
    )


def tab_fields(lines: DataFrame, *names: str, comment: str = "#") -> DataFrame:
    """Named leading tab fields of non-blank, non-comment lines; absent fields are NULL."""
    fields = F.split("value", "\t")
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    carried = [c for c in lines.columns if c != "value"]
    return kept.select(*carried, *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])

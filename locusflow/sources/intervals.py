"""Interval sources: BED and GFF3 exons, both as 0-based half-open rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.keys import prefixed_contig
from locusflow.settings import CORE_CONTIGS
from locusflow.sources.lines import tab_fields

INTERVAL_COLUMNS = ["chrom", "start", "end"]


def bed_intervals(lines: DataFrame) -> DataFrame:
    """BED lines; comments, track lines and malformed lines are skipped."""
    text = lines.where(
        ~F.col("value").startswith("track") & ~F.col("value").startswith("browser")
    ).withColumn("value", F.when(F.contains("value", F.lit("\t")), F.col("value")).otherwise(
        F.regexp_replace(F.trim("value"), r"\s+", "\t")))
    return (
        tab_fields(text, "chrom", "start", "end")
        .select(
            prefixed_contig(F.col("chrom")).alias("chrom"),
            F.trim("start").try_cast("bigint").alias("start"),
            F.trim("end").try_cast("bigint").alias("end"),
        )
        .dropna(subset=["start", "end"])
    )


def exon_intervals(lines: DataFrame, select: str = "mane") -> DataFrame:
    """GFF3 exons on the standard contigs, from 1-based inclusive to 0-based half-open."""
    rows = tab_fields(
        lines, "chrom", "source", "feature", "first", "last", "score", "strand", "phase", "attributes"
    ).where((F.col("feature") == "exon") & F.col("chrom").isin(*CORE_CONTIGS) & F.col("attributes").isNotNull())
    wanted = {
        "mane": F.col("attributes").contains("MANE_Select") | F.col("attributes").contains("MANE_Plus_Clinical"),
        "protein_coding": F.col("attributes").contains("gene_type=protein_coding"),
        "all": F.lit(True),
    }[select]
    return rows.where(wanted).select(
        "chrom",
        (F.col("first").cast("bigint") - 1).alias("start"),
        F.col("last").cast("bigint").alias("end"),
    )

"""Intervals: merging, point membership and coordinate lifting.

All intervals are 0-based half-open; positions are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.keys import bare_contig, prefixed_contig
from locusflow.operators.skew import attach, lookup

MERGE_BIN = 1 << 20
LOOKUP_BIN = 1 << 12
# Small bins for maps that travel to wide rows: a panel of short regions touches few positions.
WIDE_BIN = 1 << 10


def merge_intervals(intervals: DataFrame, pad: int = 0, bin_size: int = MERGE_BIN) -> DataFrame:
    """Pad, then join overlapping or touching intervals of each contig.

    Equal starts are reduced first, so what a window sees is limited by coordinates, not
    by the number of input rows: one bin holds at most ``bin_size`` starts and one contig
    has at most length / ``bin_size`` bins. Bins are chained by the furthest end reached
    before them.
    """
    starts = (
        intervals.select(
            "chrom",
            F.greatest(F.col("start") - pad, F.lit(0)).cast("bigint").alias("start"),
            (F.col("end") + pad).cast("bigint").alias("end"),
        )
        .groupBy("chrom", "start")
        .agg(F.max("end").alias("end"))
        .withColumn("bin", F.floor(F.col("start") / bin_size))
    )
    in_bin = Window.partitionBy("chrom", "bin").orderBy("start")
    across = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        starts.groupBy("chrom", "bin")
        .agg(F.max("end").alias("bin_end"))
        .withColumn("reached", F.max("bin_end").over(across))
        .drop("bin_end")
    )
    before = F.greatest(
        F.col("reached"), F.max("end").over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    )
    opened = (
        starts.join(reach, ["chrom", "bin"])
        .withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
        .withColumn("island_in_bin", F.sum("opens").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
    )
    earlier = (
        opened.groupBy("chrom", "bin")
        .agg(F.sum("opens").alias("n"))
        .withColumn("islands_before", F.coalesce(F.sum("n").over(across), F.lit(0)))
        .drop("n")
    )
    return (
        opened.join(earlier, ["chrom", "bin"])
        .groupBy("chrom", (F.col("islands_before") + F.col("island_in_bin")).alias("island"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def interval_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count(F.lit(1)).alias("n_regions"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("total_bases"),
    )


def _bits_below(k: Column) -> Column:
    """The lowest k of 64 bits."""
    every = F.lit(-1).cast("long")
    ones = F.call_function("shiftrightunsigned", every, (64 - k).cast("int"))
    return F.when(k <= 0, F.lit(0).cast("long")).when(k >= 64, every).otherwise(ones)


def interval_bins(merged: DataFrame, bin_size: int = LOOKUP_BIN) -> DataFrame:
    """One row per (contig, bin) with a bit for each of its ``bin_size`` positions, in 64-bit words.

    Merged intervals neither overlap nor touch, so a bin gathers at most ``bin_size / 2``
    of them before they become bits; a row is ``bin_size / 8`` bytes whatever it covers.
    """
    spans = (
        merged.where(F.col("end") > F.col("start"))
        .select(
            prefixed_contig(F.col("chrom")).alias("_contig"),
            "start",
            "end",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)
                )
            ).alias("_bin"),
        )
        .groupBy("_contig", "_bin")
        .agg(F.collect_list(F.struct((F.col("start") - F.col("_bin") * bin_size).alias("a"), (F.col("end") - F.col("_bin") * bin_size).alias("b"))).alias("_spans"))
    )
    word = lambda i: F.aggregate(
        "_spans", F.lit(0).cast("long"),
        lambda bits, s: bits.bitwiseOR(_bits_below(s["b"] - 64 * i).bitwiseAND(F.bitwise_not(_bits_below(s["a"] - 64 * i)))),
    )
    words = F.transform(F.sequence(F.lit(0), F.lit((bin_size - 1) // 64)), word)
    return spans.select("_contig", "_bin", words.alias("_bits"))


def _placed(points: DataFrame, bin_size: int) -> DataFrame:
    return points.withColumns(
        {
            "_contig": prefixed_contig(F.col("chrom")),
            "_bin": F.floor((F.col("pos") - 1) / bin_size),
        }
    )


def _bit_at_position(bin_size: int) -> Column:
    at = F.col("pos") - 1 - F.col("_bin") * bin_size
    word = F.get("_bits", F.floor(at / 64).cast("int"))
    hit = F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.coalesce(hit, F.lit(False))


def flag_inside(
    points: DataFrame, merged: DataFrame, spread_on: list[str], name: str = "inside",
    bin_size: int = LOOKUP_BIN, **skew,
) -> DataFrame:
    """Add whether each 1-based position lies in a merged interval."""
    joined = lookup(_placed(points, bin_size), interval_bins(merged, bin_size), ["_contig", "_bin"], spread_on, **skew)
    return joined.withColumn(name, _bit_at_position(bin_size)).drop("_contig", "_bin", "_bits")


def restrict_wide_rows(points: DataFrame, merged: DataFrame, spread_on: list[str], bin_size: int = WIDE_BIN) -> DataFrame:
    """Rows inside the intervals, for rows that are costly to move: the bit maps go to them if they are small."""
    inside = attach(_placed(points, bin_size), interval_bins(merged, bin_size), ["_contig", "_bin"], spread_on)
    return inside.where(_bit_at_position(bin_size)).drop("_contig", "_bin", "_bits")


def restrict_to_intervals(points: DataFrame, merged: DataFrame, spread_on: list[str], **skew) -> DataFrame:
    return flag_inside(points, merged, spread_on, "_inside", **skew).where("_inside").drop("_inside")


def lift_over(
    records: DataFrame, blocks: DataFrame, spread_on: list[str], bin_size: int = LOOKUP_BIN, **skew
) -> DataFrame:
    """Map records through aligned chain blocks and give the outcome of each.

    ``blocks`` holds ``src_chrom, src_start, src_end, dst_chrom, dst_start, dst_strand,
    dst_size`` with ungapped blocks; on the minus strand ``dst_start`` counts from the
    contig's far end. No hit is ``unmapped``, several hits are ``ambiguous``; a
    minus-strand hit is complemented for single bases and dropped as ``strand`` otherwise.
    """
    last_bin = F.floor((F.col("src_end") - 1) / bin_size)
    binned = (
        blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("src_start") / bin_size), last_bin)))
        .groupBy(F.col("src_chrom").alias("_contig"), "_bin")
        .agg(
            F.collect_list(
                F.struct("src_start", "src_end", "dst_chrom", "dst_start", "dst_strand", "dst_size")
            ).alias("_blocks")
        )
    )
    placed = records.withColumns(
        {
            "_contig": F.concat(F.lit("chr"), bare_contig(F.col("chrom"))),
            "_bin": F.floor((F.col("pos") - 1) / bin_size),
        }
    )
    zero = F.col("pos") - 1
    covering = F.filter("_blocks", lambda b: (b["src_start"] <= zero) & (zero < b["src_end"]))
    located = (
        lookup(placed, binned, ["_contig", "_bin"], spread_on, **skew)
        .withColumn("_hits", F.coalesce(covering, F.array()))
        .withColumn("_hit", F.get("_hits", F.lit(0)))
    )
    minus = F.col("_hit.dst_strand") == "-"
    along = F.col("_hit.dst_start") + zero - F.col("_hit.src_start")
    single = F.upper("ref").rlike("^[ACGT]$") & F.upper("alt").rlike("^[ACGT]$")
    outcome = (
        F.when(F.size("_hits") == 0, "unmapped")
        .when(F.size("_hits") > 1, "ambiguous")
        .when(minus & ~single, "strand")
        .otherwise("lifted")
    )
    flip = lambda c: F.when(minus, F.translate(F.upper(c), "ACGT", "TGCA")).otherwise(F.col(c))
    target = bare_contig(F.col("_hit.dst_chrom"))
    styled = F.when(F.lower("chrom").startswith("chr"), F.concat(F.lit("chr"), target)).otherwise(target)
    one_based = F.when(minus, F.col("_hit.dst_size") - 1 - along).otherwise(along) + 1
    lifted = F.col("outcome") == "lifted"
    moved = {"chrom": styled, "pos": one_based, "ref": flip("ref"), "alt": flip("alt")}
    carried = [c for c in records.columns if c not in moved]
    return located.withColumn("outcome", outcome).select(
        *carried, "outcome", *[F.when(lifted, value).alias(name) for name, value in moved.items()]
    )


def lift_lines(
    lines: DataFrame, blocks: DataFrame, spread_on: list[str], bin_size: int = LOOKUP_BIN, **skew
) -> DataFrame:
    """Outcome of every data line of VCF text, and its new coordinates where it was lifted.

    A line with fewer than eight fields or without a whole number as position is
    ``malformed``; header and blank lines have no outcome. ``lines`` has ``value``; other columns are carried.
    """
    fields = F.split("value", "\t")
    field = lambda i: F.get(fields, F.lit(i))
    parsed = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumns(
        {"chrom": field(0), "pos": F.trim(field(1)).try_cast("int"), "ref": field(3), "alt": field(4), "_fields": F.size(fields)}
    )
    broken = (F.col("_fields") < 8) | F.col("_stated").isNull()
    lifted = lift_over(parsed.withColumn("_stated", F.col("pos")), blocks, spread_on, bin_size, **skew)
    kept = {n: F.when(~broken, F.col(n)) for n in ("chrom", "pos", "ref", "alt")}
    return lifted.withColumns({"outcome": F.when(broken, "malformed").otherwise(F.col("outcome")), **kept}).drop("_fields", "_stated")


def lift_counts(lifted: DataFrame) -> DataFrame:
    return lifted.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_records"))

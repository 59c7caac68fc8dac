"""Contig naming, variant keys, zygosity and allele helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.binding import let

LOCUS = ["locus_chrom", "locus_pos", "locus_ref", "locus_alt"]


def bare_contig(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "(?i)^chr", "")


def prefixed_contig(chrom: Column) -> Column:
    return F.when(F.lower(chrom).startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def variant_key(chrom="chrom", pos="pos", ref="ref", alt="alt") -> Column:
    """``CHROM-POS-REF-ALT`` without the contig prefix and with upper-case alleles."""
    return F.concat_ws(
        "-",
        bare_contig(F.col(chrom)),
        F.col(pos).cast("string"),
        F.upper(F.col(ref)),
        F.upper(F.col(alt)),
    )


def with_locus(df: DataFrame) -> DataFrame:
    """Add the four normalised join columns shared by every locus-keyed source.

    A store laid out by locus has them already; they stay plain columns.
    """
    if set(LOCUS) <= set(df.columns):
        return df
    return df.withColumns(
        {
            "locus_chrom": prefixed_contig(F.col("chrom")),
            "locus_pos": F.col("pos").cast("int"),
            "locus_ref": F.upper("ref"),
            "locus_alt": F.upper("alt"),
        }
    )


def locus_from_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Split a textual variant key into the same four join columns, unless they are there."""
    if set(LOCUS) <= set(df.columns):
        return df
    parts = F.split(F.col(key), "-")
    return df.withColumns(
        {
            "locus_chrom": prefixed_contig(parts[0]),
            "locus_pos": parts[1].try_cast("int"),
            "locus_ref": F.upper(parts[2]),
            "locus_alt": F.upper(parts[3]),
        }
    )


def zygosity(genotype: Column, allele_number: Column) -> Column:
    """State of one ALT number; NULL for a no-call and for samples not carrying it."""
    wanted = allele_number.cast("string")

    def state(alleles: Column) -> Column:
        carried = F.size(F.filter(alleles, lambda a: a == wanted))
        missing = alleles.isNull() | F.exists(alleles, lambda a: a.isin(".", "-1"))
        return (
            F.when(missing | (carried == 0), F.lit(None).cast("string"))
            .when(F.size(alleles) == 1, "hemi")
            .when(carried == F.size(alleles), "hom")
            .otherwise("het")
        )

    return let(F.split(F.translate(genotype, "|", "/"), "/"), state)


def reportable_allele(alt: Column) -> Column:
    """True for real sequence alleles: not empty, ``*``, ``.`` or symbolic."""
    return (alt != "") & ~alt.isin("*", ".") & ~alt.startswith("<")


def minimal_allele(ref: Column, alt: Column) -> Column:
    """ALT with the bases it shares with the start of REF removed; ``-`` when nothing is left."""
    shortest = F.least(F.length(ref), F.length(alt))
    differs = F.transform(
        F.sequence(F.lit(1), shortest),
        lambda i: F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1)),
    )
    start = let(
        F.array_position(differs, F.lit(True)).cast("int"),
        lambda first: F.when(first > 0, first).otherwise(shortest + 1),
    )
    rest = let(F.substr(alt, start), lambda x: F.when(x == "", "-").otherwise(x))
    same_start = F.substr(ref, F.lit(1), F.lit(1)) == F.substr(alt, F.lit(1), F.lit(1))
    return F.when((shortest == 0) | ~same_start, F.when(alt == "", "-").otherwise(alt)).otherwise(rest)


def allele_matches(named: Column, ref: Column, alt: Column, minimal: Column) -> Column:
    """Does an annotator's allele text name this ALT, in full or minimal form?"""
    without_ref = (named == F.substr(alt, F.lit(2))) | (named == "-")
    return (named == alt) | F.when(ref == "", without_ref).otherwise(named == minimal)


def contig_list(spec: str) -> list[str]:
    """Expand a contig argument such as ``1-22,X,Y``."""
    names: list[str] = []
    for piece in (p.strip() for p in spec.split(",")):
        low, dash, high = piece.partition("-")
        if dash and low.isdigit() and high.isdigit():
            names.extend(str(n) for n in range(int(low), int(high) + 1))
        elif piece:
            names.append(piece)
    return names

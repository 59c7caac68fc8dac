"""Clinical predicates and thresholds as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusflow.settings import (
    BENIGN,
    IMPACTFUL_CONSEQUENCES,
    LIKELY_BENIGN,
    LIKELY_PATHOGENIC,
    NULL_CONSEQUENCES,
    PATHOGENIC,
    DEFAULTS,
    Thresholds,
)


def known(test: Column) -> Column:
    """A test with NULL read as false."""
    return F.coalesce(test, F.lit(False))


def asserts_pathogenic(significance: Column) -> Column:
    low = F.lower(significance)
    return known(low.startswith("pathogenic") | low.startswith("likely pathogenic"))


def asserts_benign(significance: Column) -> Column:
    low = F.lower(significance)
    return known(low.startswith("benign") | low.startswith("likely benign"))


def _review(status: Column) -> Column:
    return F.trim(F.lower(F.translate(F.coalesce(status, F.lit("")), "_", " ")))


def review_stars(status: Column) -> Column:
    text = _review(status)
    return (
        F.when(text.contains("practice guideline"), 4)
        .when(text.contains("reviewed by expert panel"), 3)
        .when(text.contains("multiple submitters") & text.contains("no conflict"), 2)
        .when(
            text.startswith("criteria provided")
            | text.contains("single submitter")
            | text.contains("conflicting"),
            1,
        )
        .otherwise(0)
    )


def is_reviewed(status: Column) -> Column:
    text = _review(status)
    return (
        text.startswith("criteria provided")
        | text.contains("reviewed by expert")
        | text.contains("practice guideline")
    )


def truth_class(significance: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(significance, F.lit(""))))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.startswith("pathogenic") | text.startswith("likely pathogenic"), "PATH")
        .when(text.startswith("benign") | text.startswith("likely benign"), "BEN")
        .otherwise("VUS")
    )


def tier_class(tier: Column) -> Column:
    return (
        F.when(tier.isin(PATHOGENIC, LIKELY_PATHOGENIC), "PATH")
        .when(tier.isin(BENIGN, LIKELY_BENIGN), "BEN")
        .otherwise("VUS")
    )


def is_null_variant(consequence: Column) -> Column:
    return known(consequence.isin(*NULL_CONSEQUENCES))


def is_inframe(consequence: Column) -> Column:
    return known(F.lower(consequence).contains("inframe"))


def is_impactful(consequence: Column) -> Column:
    return known(consequence.isin(*IMPACTFUL_CONSEQUENCES)) | is_inframe(consequence)


def is_last_exon(exon: Column) -> Column:
    rank, total = F.split(exon, "/", 2)[0], F.get(F.split(exon, "/", 2), F.lit(1))
    rank, total = F.trim(rank).try_cast("int"), F.trim(total).try_cast("int")
    return known((total > 0) & (rank == total))


def missense_pathogenic_strength(score: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(score >= t.missense_strong, "strong")
        .when(score >= t.missense_moderate, "moderate")
        .when(score >= t.missense_supporting, "supporting")
    )


def missense_benign_strength(score: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.when(score <= t.missense_benign, "supporting")


def _has(modes: Column, mode: str) -> Column:
    return known(F.array_contains(modes, mode))


def _dominant_mode(modes: Column) -> Column:
    return F.when(_has(modes, "AD"), "AD").otherwise("XL")


def pm2_ceiling(modes: Column, t: Thresholds = DEFAULTS) -> Column:
    """Strictest ceiling of the gene's modes, with the mode it came from."""
    dominant = _has(modes, "AD") | _has(modes, "XL")
    return F.struct(
        F.when(dominant, t.pm2_dominant)
        .when(_has(modes, "AR"), t.pm2_recessive)
        .otherwise(t.pm2_default)
        .alias("ceiling"),
        F.when(dominant, _dominant_mode(modes)).when(_has(modes, "AR"), "AR").alias("mode"),
    )


def bs1_cutoff(modes: Column, t: Thresholds = DEFAULTS) -> Column:
    """Most permissive cutoff of the gene's modes, with the mode it came from."""
    dominant = _has(modes, "AD") | _has(modes, "XL")
    return F.struct(
        F.when(_has(modes, "AR"), t.bs1_recessive)
        .when(dominant, t.bs1_dominant)
        .otherwise(t.bs1_default)
        .alias("cutoff"),
        F.when(_has(modes, "AR"), "AR").when(dominant, _dominant_mode(modes)).alias("mode"),
    )


def benign_frequency(faf95: Column, gnomad_af: Column, abraom_af: Column) -> Column:
    """Filtering frequency when known, else the larger known frequency, else NULL."""
    return F.coalesce(faf95, F.greatest(gnomad_af, abraom_af))


def benign_frequency_basis(faf95: Column, gnomad_af: Column, abraom_af: Column) -> Column:
    return (
        F.when(faf95.isNotNull(), "faf95")
        .when(F.coalesce(gnomad_af, abraom_af).isNotNull(), "popmax")
        .otherwise("unavailable")
    )


def predictor_direction(revel: Column, cadd: Column, t: Thresholds = DEFAULTS) -> Column:
    damaging = known(revel >= t.revel_pathogenic) | known(cadd >= t.cadd_pathogenic)
    tolerated = known(revel <= t.revel_benign) | known(cadd <= t.cadd_benign)
    return (
        F.when(damaging & tolerated, "conflicting")
        .when(damaging, "pathogenic")
        .when(tolerated, "benign")
    )


def filter_frequency(gnomad_af: Column, abraom_af: Column) -> Column:
    """Frequency as the rarity filter reads it: unknown counts as zero here, and only here."""
    zero = F.lit(0.0)
    return F.greatest(F.coalesce(gnomad_af, zero), F.coalesce(abraom_af, zero))


def is_pathogenic_tier(tier: Column) -> Column:
    return known(tier.isin(PATHOGENIC, LIKELY_PATHOGENIC))


def is_benign_tier(tier: Column) -> Column:
    return known(tier.isin(BENIGN, LIKELY_BENIGN))

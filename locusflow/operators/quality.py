"""Call-level quality gate and per-sample sequencing quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.clinical import known
from locusflow.settings import DEFAULTS, Thresholds

UNFILTERED = ("PASS", ".", "")


def passes_filter(status: Column) -> Column:
    return F.coalesce(status, F.lit("")).isin(*UNFILTERED)


def quality_reason(t: Thresholds = DEFAULTS) -> Column:
    """First failed check, or ``PASS``; unknown metrics never fail a call."""
    balance = F.col("allele_balance")
    return (
        F.when(F.col("zygosity").isNull(), "non-carrier (hom-ref / no-call / other allele)")
        .when(~passes_filter(F.col("filter_status")), F.concat(F.lit("FILTER="), F.col("filter_status")))
        .when(F.col("depth") < t.min_depth, F.format_string("DP=%d<%d", F.col("depth"), F.lit(t.min_depth)))
        .when(F.col("gq") < t.min_gq, F.format_string("GQ=%d<%d", F.col("gq"), F.lit(t.min_gq)))
        .when(
            (F.col("zygosity") == "het") & ~balance.between(t.balance_low, t.balance_high),
            F.concat(
                F.lit("AB="), balance.cast("string"), F.lit(f" outside [{t.balance_low},{t.balance_high}]")
            ),
        )
        .otherwise("PASS")
    )


def quality_class(t: Thresholds = DEFAULTS) -> Column:
    """The kind of failed check, without its values."""
    balance = F.col("allele_balance")
    return (
        F.when(F.col("zygosity").isNull(), "non-carrier")
        .when(~passes_filter(F.col("filter_status")), "FILTER")
        .when(F.col("depth") < t.min_depth, "DP")
        .when(F.col("gq") < t.min_gq, "GQ")
        .when((F.col("zygosity") == "het") & ~balance.between(t.balance_low, t.balance_high), "AB")
        .otherwise("PASS")
    )


def with_quality(calls: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return calls.withColumn("qc_reason", quality_reason(t))


def passing_calls(calls: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return calls.where(quality_class(t) == "PASS")


def drop_histogram(calls: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return (
        calls.withColumn("reason", quality_class(t))
        .where(F.col("reason") != "PASS")
        .groupBy("sample_id", "reason")
        .agg(F.count(F.lit(1)).alias("n_calls"))
    )


def assay_class(n_calls: Column) -> Column:
    return (
        F.when(n_calls >= 500_000, "whole-genome-scale")
        .when(n_calls >= 8_000, "exome / large-panel-scale")
        .when(n_calls >= 200, "targeted-panel-scale")
        .otherwise("small / demo VCF")
    )


def _percent(hits: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * hits / total, 1))


def _ratio(hits: Column, total: Column, digits: int) -> Column:
    return F.when(total > 0, F.round(hits.cast("double") / total, digits))


def _is_snv() -> Column:
    ref, alt = F.upper("ref"), F.upper("alt")
    return ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)


def _is_transition() -> Column:
    pair = F.concat(F.upper("ref"), F.upper("alt"))
    return pair.isin("AG", "GA", "CT", "TC")


def substitution_counts(calls: DataFrame) -> DataFrame:
    """Transitions and transversions per sample."""
    counted = calls.groupBy("sample_id").agg(
        F.count_if(_is_snv() & _is_transition()).alias("n_transitions"),
        F.count_if(_is_snv() & ~_is_transition()).alias("n_transversions"),
    )
    return counted.withColumn(
        "titv", _ratio(F.col("n_transitions"), F.col("n_transversions"), 2)
    )


def site_summary(calls: DataFrame) -> DataFrame:
    """Distinct sites per sample and how many carry more than one ALT."""
    sites = calls.groupBy("sample_id", "chrom", "pos").agg(F.max("n_alts").alias("alts"))
    counted = sites.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col("alts") > 1).alias("n_multiallelic_sites"),
    )
    return counted.withColumn(
        "pct_multiallelic", _percent(F.col("n_multiallelic_sites"), F.col("n_sites"))
    )


def sequencing_quality(calls: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row of quality measures per sample over all called alleles."""
    one = F.lit(1)
    has_rsid = known(F.col("variant_id").startswith("rs"))
    het_balance = (F.col("zygosity") == "het") & F.col("allele_balance").isNotNull()
    balanced = het_balance & F.col("allele_balance").between(t.balance_low, t.balance_high)
    per_sample = calls.groupBy("sample_id").agg(
        F.count(one).alias("n_variants"),
        F.count("depth").alias("n_with_dp"),
        F.avg("depth").alias("_dp_mean"),
        F.median("depth").alias("_dp_median"),
        F.count_if(F.col("depth") >= 10).alias("_dp10"),
        F.count_if(F.col("depth") >= 20).alias("_dp20"),
        F.count("gq").alias("n_with_gq"),
        F.median("gq").alias("_gq_median"),
        F.count_if(F.col("gq") >= t.min_gq).alias("_gq_ok"),
        F.count_if(_is_snv() & _is_transition()).alias("_ti"),
        F.count_if(_is_snv() & ~_is_transition()).alias("_tv"),
        F.count_if(F.col("zygosity") == "het").alias("n_het"),
        F.count_if(F.col("zygosity") == "hom").alias("n_hom"),
        F.count_if(F.length("ref") != F.length("alt")).alias("n_indel"),
        F.count_if(has_rsid).alias("n_with_rsid"),
        F.count_if(het_balance).alias("n_het_ab"),
        F.count_if(balanced).alias("_balanced"),
        F.count_if(passes_filter(F.col("filter_status"))).alias("_pass"),
    )
    n, snv = F.col("n_variants"), F.col("_ti") + F.col("_tv")
    enough_ids = F.col("n_with_rsid") >= n * 0.2
    measured = per_sample.select(
        "sample_id",
        "n_variants",
        assay_class(n).alias("assay_guess"),
        "n_with_dp",
        F.round("_dp_mean", 1).alias("dp_mean"),
        F.round("_dp_median", 1).alias("dp_median"),
        _percent(F.col("_dp10"), F.col("n_with_dp")).alias("dp_pct_ge10"),
        _percent(F.col("_dp20"), F.col("n_with_dp")).alias("dp_pct_ge20"),
        "n_with_gq",
        F.round("_gq_median", 1).alias("gq_median"),
        _percent(F.col("_gq_ok"), F.col("n_with_gq")).alias("gq_pct_ge20"),
        snv.alias("n_snv"),
        _ratio(F.col("_ti"), F.col("_tv"), 2).alias("titv"),
        "n_het",
        "n_hom",
        _ratio(F.col("n_het"), F.col("n_hom"), 2).alias("het_hom_ratio"),
        "n_indel",
        _ratio(F.col("n_indel"), snv, 3).alias("indel_snv_ratio"),
        "n_with_rsid",
        F.when(enough_ids, _percent(n - F.col("n_with_rsid"), n)).alias("pct_novel"),
        "n_het_ab",
        _percent(F.col("_balanced"), F.col("n_het_ab")).alias("pct_het_ab_balanced"),
        _percent(F.col("_pass"), n).alias("pct_pass"),
    )
    return measured.join(site_summary(calls), "sample_id")


def quality_notes(quality: DataFrame) -> DataFrame:
    """One row per applicable note: the note's code and the value it is about."""
    note = lambda code, value: F.struct(F.lit(code).alias("note"), value.cast("double").alias("value"))
    notes = F.array_compact(
        F.array(
            note("depth_at_called_sites_only", F.lit(None)),
            F.when(F.col("titv").isNotNull(), note("titv", F.col("titv"))),
            F.when(F.col("dp_median") < 20, note("low_median_depth", F.col("dp_median"))),
            F.when(
                (F.col("n_variants") > 0) & F.col("pct_novel").isNull(),
                note("no_rsids_novelty_not_computed", F.lit(None)),
            ),
        )
    )
    return quality.select("sample_id", F.explode(notes).alias("n")).select("sample_id", "n.note", "n.value")

"""Rarity and impact selection, ranking keys and the per-sample funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.clinical import asserts_pathogenic, filter_frequency, is_impactful
from locusflow.operators.quality import passes_filter, quality_class
from locusflow.operators.ranking import position_in_group
from locusflow.settings import DEFAULTS, Thresholds


def _asserted() -> Column:
    return asserts_pathogenic(F.col("clinvar_significance"))


def is_rare(t: Thresholds = DEFAULTS) -> Column:
    frequency = filter_frequency(F.col("gnomad_af"), F.col("abraom_af"))
    return (frequency <= t.max_af) | _asserted()


def has_impact() -> Column:
    return is_impactful(F.col("consequence")) | _asserted()


def candidates(annotated: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return annotated.where(is_rare(t) & has_impact())


def rescued_by_local_frequency(annotated: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Calls only the local population frequency removes, with a readable note."""
    zero = F.lit(0.0)
    gnomad, local = F.coalesce("gnomad_af", zero), F.coalesce("abraom_af", zero)
    label = F.coalesce(F.col("gene"), F.col("variant_key"))
    note = F.format_string(
        "%s (%s): gnomAD AF=%.6f but ABraOM AF=%.4f",
        label, F.coalesce(F.col("hgvs_p"), F.col("variant_key")), gnomad, local,
    )
    return annotated.where((gnomad <= t.max_af) & (local > t.max_af) & ~_asserted()).withColumn("note", note)


#: What the order of candidates reads of a call beside its phenotype score and the tie columns.
RANKED_ON = ["clinvar_significance", "gnomad_af", "abraom_af"]


def rank_order(tie: list[str]) -> list[Column]:
    """Asserted pathogenic first, better phenotype score, rarer, then input order."""
    return [
        _asserted().cast("int").desc(),
        F.coalesce("hpo_match_score", F.lit(0.0)).desc(),
        filter_frequency(F.col("gnomad_af"), F.col("abraom_af")).asc(),
        *[F.col(c).asc() for c in tie],
    ]


def rank_candidates(df: DataFrame, tie: list[str] = ["line_no", "alt_index"]) -> DataFrame:
    return position_in_group(df, ["sample_id"], rank_order(tie), "candidate_rank")


def funnel(annotated: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Counts surviving each step, for all samples in one aggregation over all calls."""
    kept = quality_class(t) == "PASS"
    rare = kept & is_rare(t)
    impact = rare & has_impact()
    count = lambda test, name: F.count_if(test).alias(name)
    return annotated.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total_variants"),
        count(passes_filter(F.col("filter_status")), "pass_filter"),
        count(kept, "after_qc"),
        count(rare, "after_rarity"),
        count(impact, "after_impact"),
        count(impact, "candidates"),
    )


def unresolved_store_warning(annotated: DataFrame, min_calls: int = 50) -> DataFrame:
    """Samples whose store lookup matched nothing although enough calls were kept."""
    counted = annotated.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.count_if(F.col("frequency_state") != "unknown").alias("n_resolved"),
    )
    return counted.withColumn(
        "over_call_warning", (F.col("n_kept") >= min_calls) & (F.col("n_resolved") == 0)
    )


def sample_choice_warning(headers: DataFrame, sample: str | None) -> DataFrame:
    """Files with several samples read without naming the proband."""
    n = F.size("sample_names")
    unnamed = F.lit(sample is None)
    return headers.select("file", n.alias("n_samples"), ((n > 1) & unnamed).alias("defaulted_to_first"))

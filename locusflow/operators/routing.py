"""Routing of classified calls, review flags, triage of uncertain calls and conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.clinical import (
    asserts_pathogenic,
    is_benign_tier,
    is_pathogenic_tier,
    known,
    review_stars,
)
from locusflow.functions.keys import variant_key
from locusflow.operators.ranking import position_in_group, top_per_group
from locusflow.operators.selection import rank_order
from locusflow.operators.skew import attach
from locusflow.settings import DEFAULTS, LIKELY_PATHOGENIC, PATHOGENIC, TIERS, VUS, Thresholds

c = F.col


def is_related(t: Thresholds = DEFAULTS) -> Column:
    return F.coalesce(c("hpo_match_score"), F.lit(0.0)) >= t.related_score


def is_absent_homozygote() -> Column:
    """Homozygous for an allele the store vouches is absent; an unknown frequency is not absent."""
    return known((c("zygosity") == "hom") & (c("gnomad_af") == 0.0))


def recessive_only() -> Column:
    has = lambda mode: known(F.array_contains("modes", mode))
    return has("AR") & ~has("AD") & ~has("XL")


def pathogenic_hits(classified: DataFrame) -> DataFrame:
    """Pathogenic and likely pathogenic calls per sample and gene."""
    return (
        classified.where(is_pathogenic_tier(c("tier")))
        .groupBy("sample_id", "gene")
        .agg(F.count(F.lit(1)).alias("n_pathogenic"))
    )


def with_second_hit(classified: DataFrame) -> DataFrame:
    """Mark calls whose gene has two or more pathogenic calls in the sample.

    Only those genes enter the join, so its right side is small and goes to the calls as far as
    its measured size allows.
    """
    several = pathogenic_hits(classified).where(c("n_pathogenic") >= 2).select(
        "sample_id", "gene", F.lit(True).alias("second_hit")
    )
    spread_on = [x for x in ("sample_id", "line_no") if x in classified.columns]
    return attach(classified, several, ["sample_id", "gene"], spread_on).withColumn(
        "second_hit", F.coalesce("second_hit", F.lit(False))
    )


def is_carrier() -> Column:
    """A lone heterozygous pathogenic call in a gene known only for recessive disease."""
    return known(
        is_pathogenic_tier(c("tier")) & (c("zygosity") == "het") & recessive_only() & ~c("second_hit")
    )


def finding_bucket(t: Thresholds = DEFAULTS) -> Column:
    """First matching rule decides; carriers and artifacts are part of ``other``."""
    related, pathogenic = is_related(t), is_pathogenic_tier(c("tier"))
    return (
        F.when(is_absent_homozygote() & ~(related & pathogenic), "other")
        .when(is_carrier(), "other")
        .when(related & ~is_benign_tier(c("tier")), "primary")
        .when(~related & pathogenic & known(c("secondary_gene")), "secondary")
        .otherwise("other")
    )


def is_not_to_dismiss() -> Column:
    """A well-reviewed pathogenic assertion sitting below a pathogenic tier."""
    return (
        asserts_pathogenic(c("clinvar_significance"))
        & (review_stars(c("clinvar_review_status")) >= 2)
        & ~is_pathogenic_tier(c("tier"))
    )


SIGNAL_NAMES = {
    "missense_high": "AlphaMissense likely-pathogenic",
    "missense_mid": "AlphaMissense ambiguous",
    "phenotype": "phenotype match",
    "asserted": "ClinVar Pathogenic assertion",
    "conflicting": "ClinVar conflicting",
    "constraint": "LoF-intolerant gene",
}
SIGNAL_WEIGHTS = {
    "missense_high": 3, "missense_mid": 1, "phenotype": 2, "asserted": 2, "conflicting": 1, "constraint": 1,
}


def signal_tests(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    score, text = c("am_pathogenicity"), F.lower(F.coalesce(c("clinvar_significance"), F.lit("")))
    conflict = text.contains("conflict")
    return {
        "missense_high": known(score >= t.missense_supporting),
        "missense_mid": known((score >= t.missense_benign) & (score < t.missense_supporting)),
        "phenotype": is_related(t),
        "asserted": text.contains("pathogenic") & ~conflict,
        "conflicting": conflict,
        "constraint": known(c("lof_intolerant")),
    }


def triage_score(t: Thresholds = DEFAULTS, molecular_only: bool = False) -> Column:
    weights = [
        F.when(test, SIGNAL_WEIGHTS[name]).otherwise(0)
        for name, test in signal_tests(t).items()
        if not (molecular_only and name == "phenotype")
    ]
    return sum(weights[1:], weights[0])


def signals(t: Thresholds = DEFAULTS) -> Column:
    tests = signal_tests(t)
    return F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(F.lit(SIGNAL_NAMES[n]).alias("signal"), F.lit(SIGNAL_WEIGHTS[n]).alias("weight")),
                )
                for n, test in tests.items()
            ]
        )
    )


def is_probable_vus(t: Thresholds = DEFAULTS) -> Column:
    """Uncertain, phenotype-related and with enough molecular weight."""
    return (c("tier") == VUS) & is_related(t) & (triage_score(t, molecular_only=True) >= t.min_molecular)


#: What routing reads of a classified call.
ROUTED_ON = [
    "sample_id", "gene", "tier", "zygosity", "modes", "gnomad_af", "hpo_match_score", "secondary_gene",
    "clinvar_significance", "clinvar_review_status", "am_pathogenicity", "lof_intolerant",
]


def route(classified: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Add bucket and review flags to every classified call."""
    return with_second_hit(classified).withColumns(
        {
            "bucket": finding_bucket(t),
            "carrier": is_carrier(),
            "absent_homozygote": is_absent_homozygote(),
            "not_to_dismiss": is_not_to_dismiss(),
            "probable_vus": is_probable_vus(t),
            "triage_score": F.when(is_probable_vus(t), triage_score(t)),
        }
    )


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TIERS]), tier).cast("int")


def report_order(tie: list[str]) -> list[Column]:
    return [tier_rank(c("tier")).asc(), *rank_order(tie)]


TIE = ["line_no", "alt_index"]


def rank_report(routed: DataFrame, tie: list[str] = TIE) -> DataFrame:
    """Position in the sample's report: by tier, candidate order inside a tier."""
    return position_in_group(routed, ["sample_id"], report_order(tie), "report_rank")


def _vus_order(tie: list[str]) -> list[Column]:
    return [c("triage_score").desc(), *rank_order(tie)]


def rank_probable_vus(routed: DataFrame, tie: list[str] = TIE) -> DataFrame:
    return position_in_group(routed.where("probable_vus"), ["sample_id"], _vus_order(tie), "vus_rank")


def top_probable_vus(routed: DataFrame, k: int = 3, tie: list[str] = TIE) -> DataFrame:
    return top_per_group(routed.where("probable_vus"), ["sample_id"], _vus_order(tie), k, "vus_rank")


def exploration_notes(vus: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    names = F.array_join(F.transform(signals(t), lambda s: s["signal"]), ", ")
    change = F.coalesce("hgvs_p", "hgvs_c", variant_key())
    return vus.withColumn("note", F.concat(c("gene"), F.lit(" "), change, F.lit(" — VUS with "), names))


def not_to_dismiss_columns() -> list[Column]:
    return [
        c("gene"),
        variant_key().alias("variant"),
        F.coalesce("hgvs_p", "hgvs_c").alias("hgvs"),
        c("tier").alias("engine_tier"),
        c("clinvar_significance"),
        c("clinvar_review_status"),
        review_stars(c("clinvar_review_status")).alias("clinvar_stars"),
        c("clinvar_accession"),
    ]


def not_to_dismiss(routed: DataFrame) -> DataFrame:
    return routed.where("not_to_dismiss").select("sample_id", *not_to_dismiss_columns())


def conclusion_items(routed: DataFrame, quality: DataFrame) -> DataFrame:
    """The conclusion of every sample as rows: section order, section, gene and detail.

    One row per named finding, so a sample with many findings never becomes one value.
    Sections without findings appear only where the absence itself is the statement.
    """
    pathogenic = is_pathogenic_tier(c("tier"))
    sections = F.array_compact(
        F.array(
            F.when((c("bucket") == "primary") & pathogenic, F.struct(F.lit(1).alias("n"), F.lit("diagnosis").alias("section"))),
            F.when(c("not_to_dismiss"), F.struct(F.lit(3).alias("n"), F.lit("do not dismiss").alias("section"))),
            F.when(c("absent_homozygote") & pathogenic, F.struct(F.lit(4).alias("n"), F.lit("verify genotype").alias("section"))),
            F.when((c("bucket") == "secondary") & pathogenic, F.struct(F.lit(5).alias("n"), F.lit("secondary finding").alias("section"))),
            F.when(c("carrier"), F.struct(F.lit(6).alias("n"), F.lit("carrier").alias("section"))),
            F.when(
                (c("bucket") == "other") & pathogenic & ~c("carrier"),
                F.struct(F.lit(7).alias("n"), F.lit("other pathogenic").alias("section")),
            ),
        )
    )
    findings = routed.select("sample_id", "gene", c("tier").alias("detail"), F.explode(sections).alias("s")).select(
        "sample_id", "s.n", "s.section", "gene", "detail"
    )
    # At most three rows per sample by definition of the section.
    uncertain = top_probable_vus(routed).select(
        "sample_id", F.lit(8).alias("n"), F.lit("probable pathogenic VUS").alias("section"), "gene",
        F.array_join(F.transform(signals(), lambda s: s["signal"]), ", ").alias("detail"),
    )
    in_primary = c("bucket") == "primary"
    counted = routed.groupBy("sample_id").agg(
        F.count_if(in_primary & pathogenic).alias("n_diagnoses"),
        F.count_if(in_primary & (c("tier") == VUS)).alias("n_uncertain"),
    )
    none = quality.select("sample_id").join(counted, "sample_id", "left").where(F.coalesce("n_diagnoses", F.lit(0)) == 0).select(
        "sample_id", F.lit(2).alias("n"), F.lit("no pathogenic finding").alias("section"),
        F.lit(None).cast("string").alias("gene"),
        F.concat(F.coalesce("n_uncertain", F.lit(0)).cast("string"), F.lit(" uncertain")).alias("detail"),
    )
    fixed = F.array_compact(
        F.array(
            F.when(
                c("dp_median").isNotNull(),
                F.struct(
                    F.lit(9).alias("n"),
                    F.when(c("dp_median") < 20, "coverage limitation").otherwise("depth adequate").alias("section"),
                    F.concat(F.lit("median "), c("dp_median").cast("string")).alias("detail"),
                ),
            ),
            F.struct(F.lit(10).alias("n"), F.lit("single proband").alias("section"), F.lit("PS2, PM3, PM6, PP1, BS4 not assessed").alias("detail")),
            F.struct(F.lit(11).alias("n"), F.lit("next steps").alias("section"), F.lit("expert review and orthogonal confirmation").alias("detail")),
        )
    )
    standing = quality.select("sample_id", F.explode(fixed).alias("s")).select(
        "sample_id", "s.n", "s.section", F.lit(None).cast("string").alias("gene"), "s.detail"
    )
    return findings.unionByName(uncertain).unionByName(none).unionByName(standing).withColumnRenamed("n", "section_no")


OUTCOMES = ("primary", "secondary", "carrier", "probable_vus", "other", "absent")


def outcome_rank() -> Column:
    """Priority of one routed call in the labelled-gene outcome."""
    return (
        F.when(c("bucket") == "primary", 1)
        .when(c("bucket") == "secondary", 2)
        .when(c("carrier"), 3)
        .when(c("probable_vus"), 4)
        .otherwise(5)
    )

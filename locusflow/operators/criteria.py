"""The 21 evidence criteria as column expressions.

``strengths`` gives, for each code, the strength a call earns or NULL. Everything the
combiner needs is in those scalar columns, so classification stays inside generated
code; the readable trail is an optional second projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.clinical import (
    asserts_benign,
    asserts_pathogenic,
    benign_frequency,
    benign_frequency_basis,
    bs1_cutoff,
    is_inframe,
    is_last_exon,
    is_null_variant,
    is_reviewed,
    known,
    missense_benign_strength,
    missense_pathogenic_strength,
    pm2_ceiling,
    predictor_direction,
)
from locusflow.settings import CRITERIA, DEFAULTS, Thresholds

VERY_STRONG, STRONG, MODERATE, SUPPORTING, STAND_ALONE = (
    "very_strong", "strong", "moderate", "supporting", "stand_alone",
)

DEFAULT_STRENGTH = {
    "PVS1": VERY_STRONG,
    "PS1": STRONG, "PS2": STRONG, "PS3": STRONG, "PS4": STRONG,
    "PM1": MODERATE, "PM2": MODERATE, "PM3": MODERATE, "PM4": MODERATE, "PM5": MODERATE, "PM6": MODERATE,
    "PP2": SUPPORTING, "PP3": SUPPORTING, "PP4": SUPPORTING, "PP5": SUPPORTING,
    "BA1": STAND_ALONE, "BS1": STRONG, "BS2": STRONG,
    "BP4": SUPPORTING, "BP6": SUPPORTING, "BP7": SUPPORTING,
}
TITLES = {
    "PVS1": "Null variant where loss of function causes disease",
    "PS1": "Same protein change as another pathogenic variant",
    "PS2": "Confirmed de novo",
    "PS3": "Functional studies show damage",
    "PS4": "More frequent in patients than in controls",
    "PM1": "Hotspot or critical domain",
    "PM2": "Absent or ultra-rare in populations",
    "PM3": "In trans with a pathogenic variant",
    "PM4": "Protein length change",
    "PM5": "Other pathogenic missense at the residue",
    "PM6": "Assumed de novo",
    "PP2": "Missense where missense is a mechanism",
    "PP3": "Predictors support damage",
    "PP4": "Phenotype fits the gene",
    "PP5": "Reputable source calls it pathogenic",
    "BA1": "Common: at least 5 percent",
    "BS1": "More frequent than the disorder allows",
    "BS2": "Seen in healthy homozygotes",
    "BP4": "Predictors support no impact",
    "BP6": "Reputable source calls it benign",
    "BP7": "Synonymous",
}
# Codes a single-sample call table can never establish.
NOT_APPLICABLE = ("PS2", "PM3", "PM6")
# Codes left to an expert: always shown, never met.
LEFT_TO_EXPERT = {"PS1": "moderate", "PS3": "low", "PS4": "low", "PM1": "moderate", "PM5": "moderate", "PP2": "moderate"}

c = F.col


def pvs1_mechanism() -> Column:
    return known(c("lof_intolerant")) | known(c("haploinsufficient")) | known(c("recessive_mechanism"))


def pvs1_basis() -> Column:
    return (
        F.when(known(c("haploinsufficient")), "haploinsufficiency")
        .when(known(c("lof_intolerant")), "constraint")
        .when(known(c("recessive_mechanism")), "recessive phenotype")
    )


def pvs1(t: Thresholds) -> Column:
    consequence, exon = c("consequence"), c("exon")
    truncating = consequence.isin("stop_gained", "frameshift_variant")
    graded = (
        F.when(F.coalesce(exon, F.lit("")) == "", VERY_STRONG)
        .when(consequence == "start_lost", MODERATE)
        .when(truncating & is_last_exon(exon), STRONG)
        .otherwise(VERY_STRONG)
    )
    return F.when(is_null_variant(consequence) & pvs1_mechanism(), graded)


def pm2(t: Thresholds) -> Column:
    ceiling = pm2_ceiling(c("modes"), t)["ceiling"]
    local = F.coalesce(c("abraom_af"), F.lit(0.0))
    return F.when((c("gnomad_af") <= ceiling) & (local <= ceiling), t.pm2_strength)


def pm4(t: Thresholds) -> Column:
    return F.when(is_inframe(c("consequence")) | (F.lower("consequence") == "stop_lost"), MODERATE)


def pp3(t: Thresholds) -> Column:
    score = c("am_pathogenicity")
    fallback = F.when(predictor_direction(c("revel"), c("cadd_phred"), t) == "pathogenic", SUPPORTING)
    return F.when(score.isNotNull(), missense_pathogenic_strength(score, t)).otherwise(fallback)


def pp4(t: Thresholds) -> Column:
    return F.when(c("hpo_match_score") >= t.pp4_score, SUPPORTING)


def pp5(t: Thresholds) -> Column:
    met = asserts_pathogenic(c("clinvar_significance")) & is_reviewed(c("clinvar_review_status"))
    return F.when(met, SUPPORTING)


def _benign_af() -> Column:
    return benign_frequency(c("gnomad_faf95"), c("gnomad_af"), c("abraom_af"))


def ba1(t: Thresholds) -> Column:
    return F.when(_benign_af() >= t.ba1_af, STAND_ALONE)


def bs1(t: Thresholds) -> Column:
    af = _benign_af()
    return F.when((af >= bs1_cutoff(c("modes"), t)["cutoff"]) & (af < t.ba1_af), STRONG)


def bs2(t: Thresholds) -> Column:
    return F.when(c("gnomad_homozygotes") >= t.bs2_homozygotes, STRONG)


def bp4(t: Thresholds) -> Column:
    score = c("am_pathogenicity")
    fallback = F.when(predictor_direction(c("revel"), c("cadd_phred"), t) == "benign", SUPPORTING)
    return F.when(score.isNotNull(), missense_benign_strength(score, t)).otherwise(fallback)


def bp6(t: Thresholds) -> Column:
    met = asserts_benign(c("clinvar_significance")) & is_reviewed(c("clinvar_review_status"))
    return F.when(met, SUPPORTING)


def bp7(t: Thresholds) -> Column:
    return F.when(c("consequence") == "synonymous_variant", SUPPORTING)


# The plug point: codes decided from data, in report order. Other codes are never met.
DECIDED = {
    "PVS1": pvs1, "PM2": pm2, "PM4": pm4, "PP3": pp3, "PP4": pp4, "PP5": pp5,
    "BA1": ba1, "BS1": bs1, "BS2": bs2, "BP4": bp4, "BP6": bp6, "BP7": bp7,
}

INPUTS = {
    "gene": "string", "consequence": "string", "exon": "string", "hgvs_p": "string",
    "gnomad_af": "double", "gnomad_faf95": "double", "gnomad_homozygotes": "bigint", "abraom_af": "double",
    "clinvar_significance": "string", "clinvar_review_status": "string", "clinvar_accession": "string",
    "revel": "double", "cadd_phred": "double", "am_pathogenicity": "double", "am_class": "string",
    "lof_intolerant": "boolean", "haploinsufficient": "boolean", "recessive_mechanism": "boolean",
    "modes": "array<string>", "hpo_match_score": "double", "n_matched_terms": "int",
}


def with_inputs(df: DataFrame) -> DataFrame:
    """Add any missing criterion input as NULL, so partial evidence can be classified."""
    return df.withColumns(
        {name: F.lit(None).cast(type_) for name, type_ in INPUTS.items() if name not in df.columns}
    )


def strengths(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    never = F.lit(None).cast("string")
    return {code: DECIDED[code](t) if code in DECIDED else never for code in CRITERIA}


def strength_column(code: str) -> str:
    return f"{code.lower()}_strength"


def with_strengths(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One nullable strength column per decided code, in a single projection."""
    ready = with_inputs(df)
    return ready.select("*", *[build(t).alias(strength_column(code)) for code, build in DECIDED.items()])


def earned() -> dict[str, Column]:
    """Strength columns added by :func:`with_strengths`, by code."""
    return {code: c(strength_column(code)) for code in DECIDED}


def _text(value: Column) -> Column:
    return value.cast("string")


def _number(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def _evidence(t: Thresholds) -> dict[str, dict[str, Column]]:
    ceiling, cutoff = pm2_ceiling(c("modes"), t), bs1_cutoff(c("modes"), t)
    basis = benign_frequency_basis(c("gnomad_faf95"), c("gnomad_af"), c("abraom_af"))
    lit = lambda x: F.lit(str(x))
    populations = {"gnomad_af": _text(c("gnomad_af")), "abraom_af": _text(c("abraom_af"))}
    predictors = {
        "am_pathogenicity": _text(c("am_pathogenicity")), "am_class": c("am_class"),
        "revel": _text(c("revel")), "cadd_phred": _text(c("cadd_phred")),
    }
    assertion = {"clinvar": c("clinvar_significance"), "review_status": c("clinvar_review_status")}
    consequence = {"consequence": c("consequence")}
    protein = {"hgvs_p": c("hgvs_p")}
    return {
        "PVS1": {
            **consequence, "lof_intolerant": _text(c("lof_intolerant")), "basis": pvs1_basis(),
            "inheritance": F.array_join(F.sort_array("modes"), "+"), "exon": c("exon"),
        },
        "PS1": protein,
        "PS4": populations,
        "PM1": {**consequence, **protein},
        "PM2": {**populations, "ceiling": _text(ceiling["ceiling"]), "inheritance": ceiling["mode"], "model": lit(t.model)},
        "PM4": consequence,
        "PM5": protein,
        "PP2": {**consequence, "gene": c("gene")},
        "PP3": {**predictors, "revel_cutoff": lit(t.revel_pathogenic), "cadd_cutoff": lit(t.cadd_pathogenic)},
        "PP4": {"hpo_match_score": _text(c("hpo_match_score")), "matched_terms": _text(c("n_matched_terms")), "cutoff": lit(t.pp4_score)},
        "PP5": assertion,
        "BA1": {"af": _text(_benign_af()), "cutoff": lit(t.ba1_af), "basis": basis},
        "BS1": {"af": _text(_benign_af()), "cutoff": _text(cutoff["cutoff"]), "inheritance": cutoff["mode"], "basis": basis},
        "BS2": {"homozygotes": _text(F.coalesce(c("gnomad_homozygotes"), F.lit(0))), "cutoff": lit(t.bs2_homozygotes)},
        "BP4": {**predictors, "revel_cutoff": lit(t.revel_benign), "cadd_cutoff": lit(t.cadd_benign)},
        "BP6": assertion,
        "BP7": consequence,
    }


def _reasons(t: Thresholds) -> dict[str, Column]:
    """Why a code was or was not met, from the values that decided it."""
    none = F.lit("unknown")
    shown = lambda value, digits: F.coalesce(_number(value, digits), none)
    met = lambda code: c(strength_column(code)).isNotNull()
    ceiling, cutoff = pm2_ceiling(c("modes"), t)["ceiling"], bs1_cutoff(c("modes"), t)["cutoff"]
    benign_af = shown(_benign_af(), 4)
    named = F.coalesce(c("consequence"), F.lit("no consequence"))
    predictors = F.concat(
        F.lit("missense score "), shown(c("am_pathogenicity"), 3),
        F.lit(", REVEL "), shown(c("revel"), 3), F.lit(", CADD "), shown(c("cadd_phred"), 1),
    )
    asserted = F.concat_ws(" / ", F.coalesce(c("clinvar_significance"), F.lit("no assertion")), c("clinvar_review_status"))
    return {
        "PVS1": F.when(met("PVS1"), F.concat(named, F.lit(" in a loss-of-function gene by "), pvs1_basis(), F.lit(", graded "), c("pvs1_strength")))
        .when(is_null_variant(c("consequence")), F.concat(named, F.lit(" without a known loss-of-function mechanism")))
        .otherwise(F.concat(named, F.lit(" is not a null variant"))),
        "PM2": F.when(c("gnomad_af").isNull(), "population frequency unavailable").otherwise(
            F.concat(
                F.lit("gnomAD "), shown(c("gnomad_af"), 6), F.lit(", ABraOM "),
                F.coalesce(_number(c("abraom_af"), 6), F.lit("not checked")),
                F.when(met("PM2"), " at or under ").otherwise(" above "), _text(ceiling),
            )
        ),
        "PM4": named,
        "PP3": predictors,
        "PP4": F.concat(F.lit("phenotype score "), shown(F.coalesce(c("hpo_match_score"), F.lit(0.0)), 2)),
        "PP5": asserted,
        "BA1": F.concat(F.lit("frequency "), benign_af, F.lit(" against "), F.lit(str(t.ba1_af))),
        "BS1": F.concat(F.lit("frequency "), benign_af, F.lit(" against "), _text(cutoff)),
        "BS2": F.concat(_text(F.coalesce(c("gnomad_homozygotes"), F.lit(0))), F.lit(" homozygotes")),
        "BP4": predictors,
        "BP6": asserted,
        "BP7": named,
    }


def _citations() -> dict[str, Column]:
    source = lambda test, name: F.when(test, F.lit(name))
    populations = F.array_compact(
        F.array(source(c("gnomad_af").isNotNull(), "gnomAD"), source(c("abraom_af").isNotNull(), "ABraOM"))
    )
    missense = F.array_compact(F.array(source(c("am_pathogenicity").isNotNull(), "AlphaMissense")))
    assertion = lambda code: F.array_compact(F.array(F.when(c(strength_column(code)).isNotNull(), c("clinvar_accession"))))
    return {
        "PVS1": F.array_compact(
            F.array(
                source(known(c("haploinsufficient")), "ClinGen dosage"),
                source(c("lof_intolerant").isNotNull(), "gnomAD constraint"),
                source(pvs1_basis() == "recessive phenotype", "HPO inheritance"),
            )
        ),
        "PM2": populations, "BA1": populations, "BS1": populations,
        "BS2": F.array_compact(F.array(source(c("gnomad_homozygotes").isNotNull(), "gnomAD"))),
        "PP3": missense, "BP4": missense,
        "PP4": F.array_compact(F.array(source(c("hpo_match_score") > 0, "HPO"))),
        "PP5": assertion("PP5"), "BP6": assertion("BP6"),
    }


def trail(t: Thresholds = DEFAULTS, fields: list[str] | None = None) -> Column:
    """All 21 criteria in report order as an array of structs with their evidence, or with the ``fields`` asked for."""
    evidence, reasons, citations = _evidence(t), _reasons(t), _citations()
    nothing = F.create_map().cast("map<string,string>")
    uncited = F.array().cast("array<string>")
    rows = []
    for code in CRITERIA:
        strength = c(strength_column(code)) if code in DECIDED else F.lit(None).cast("string")
        expert = code in LEFT_TO_EXPERT
        values = evidence.get(code, {})
        held = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else nothing
        if code in NOT_APPLICABLE:
            reason, confidence = F.lit("needs family or phase data"), F.lit("high")
        elif expert:
            reason, confidence = F.lit("left to expert review"), F.lit(LEFT_TO_EXPERT[code])
        elif code == "PM2":
            reason = reasons[code]
            confidence = F.when(c("gnomad_af").isNull(), "low").otherwise("high")
        elif code in ("PP3", "BP4"):
            reason = reasons[code]
            confidence = F.when(c("am_pathogenicity").isNotNull(), "moderate").otherwise("high")
        else:
            reason = reasons[code]
            confidence = F.lit("moderate" if code in ("PP5", "BP6") else "high")
        values = {
            "code": F.lit(code),
            "name": F.lit(TITLES[code]),
            "default_strength": F.lit(DEFAULT_STRENGTH[code]),
            "applies": F.lit(code not in NOT_APPLICABLE),
            "met": strength.isNotNull(),
            "applied_strength": strength,
            "evidence": held,
            "citation": citations.get(code, uncited),
            "reasoning": reason,
            "confidence": confidence,
            "adjudicated_by": F.lit("model" if expert else "engine"),
        }
        rows.append(F.struct(*[v.alias(n) for n, v in values.items() if fields is None or n in fields]))
    return F.array(*rows)

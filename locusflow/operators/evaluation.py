"""Labelled evaluation: panel metrics, planted-gene outcomes, cohort selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.clinical import (
    asserts_pathogenic,
    filter_frequency,
    is_null_variant,
    is_pathogenic_tier,
    known,
    tier_class,
    truth_class,
)
from locusflow.functions.keys import LOCUS, locus_from_key, prefixed_contig
from locusflow.operators.ranking import position_in_group, top_per_group
from locusflow.operators.routing import OUTCOMES, outcome_rank, tier_rank

c = F.col
CLASSES = ("PATH", "VUS", "BEN")


def panel_entries(panel: DataFrame, frequencies: DataFrame, missense: DataFrame) -> DataFrame:
    """Panel rows with a definite truth, joined to frozen snapshots; no snapshot means unknown."""
    text = lambda name: F.when(c(name) != "", c(name)).alias(name)
    entries = locus_from_key(panel.withColumn("truth_class", truth_class(c("clinvar_significance")))).where(
        c("truth_class").isin("PATH", "BEN")
    )
    entries = entries.select(
        "key", text("gene"), text("consequence"), text("hgvs_p"), "truth_class",
        c("clinvar_significance").alias("truth_significance"), text("review_status"), text("accession"), *LOCUS,
    )
    frozen = frequencies.select(
        "key", c("af").alias("gnomad_af"), c("faf95").alias("gnomad_faf95"), c("hom").alias("gnomad_homozygotes")
    )
    scores = missense.select("key", "am_pathogenicity", "am_class")
    return entries.join(frozen, "key", "left").join(scores, "key", "left")


def withhold_assertions(annotated: DataFrame) -> DataFrame:
    """Blank the clinical assertions, so they cannot confirm the label they are."""
    names = ["clinvar_significance", "clinvar_review_status", "clinvar_accession"]
    return annotated.withColumns({n: F.lit(None).cast("string") for n in names})


def panel_rows(classified: DataFrame) -> DataFrame:
    engine = tier_class(c("tier"))
    truth = c("truth_class")
    gross = ((truth == "PATH") & (engine == "BEN")) | ((truth == "BEN") & (engine == "PATH"))
    return classified.withColumns(
        {
            "engine_class": engine,
            "is_null_variant": is_null_variant(c("consequence")),
            "concordant": engine == truth,
            "gross": gross,
        }
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Truth by call counts; all nine cells are present."""
    columns = [F.count_if((c("truth_class") == t) & (c("engine_class") == e)).alias(f"{t}_{e}") for t in CLASSES for e in CLASSES]
    counted = rows.agg(*columns)
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("truth"), *[c(f"{t}_{e}").alias(f"called_{e.lower()}") for e in CLASSES])
            for t in CLASSES
        ]
    )
    return counted.select(F.explode(cells).alias("m")).select("m.*")


def _rate(hits: Column, total: Column) -> Column:
    return F.coalesce(F.when(total > 0, F.round(hits / total, 4)), F.lit(0.0))


def panel_metrics(rows: DataFrame) -> DataFrame:
    """Headline figures of the panel in one row; an empty denominator gives 0."""
    truth, call = c("truth_class"), c("engine_class")
    path, ben, decisive = truth == "PATH", truth == "BEN", call != "VUS"
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(path).alias("n_pathogenic"),
        F.count_if(ben).alias("n_benign"),
        F.count_if(path & c("is_null_variant")).alias("n_lof_pathogenic"),
        F.count_if("concordant").alias("_agree"),
        F.count_if(decisive).alias("_decisive"),
        F.count_if(decisive & c("concordant")).alias("_decisive_agree"),
        F.count_if(call == "PATH").alias("_called_path"),
        F.count_if(call == "BEN").alias("_called_ben"),
        F.count_if(path & (call == "PATH")).alias("_true_path"),
        F.count_if(ben & (call == "BEN")).alias("_true_ben"),
        F.count_if(path & c("is_null_variant") & (call == "PATH")).alias("_true_lof"),
        F.count_if(ben & (call != "PATH")).alias("_not_path"),
        F.count_if("gross").alias("gross_discordances"),
    )
    rate = lambda hits, total, name: _rate(c(hits), c(total)).alias(name)
    return counts.select(
        "n", "n_pathogenic", "n_benign", "n_lof_pathogenic",
        rate("_agree", "n", "concordance"),
        rate("_decisive", "n", "decisiveness"),
        rate("_decisive_agree", "_decisive", "concordance_when_decisive"),
        rate("_true_path", "_called_path", "pathogenic_precision"),
        rate("_true_ben", "_called_ben", "benign_precision"),
        rate("_true_path", "n_pathogenic", "pathogenic_sensitivity"),
        rate("_true_lof", "n_lof_pathogenic", "lof_pathogenic_sensitivity"),
        rate("_true_ben", "n_benign", "benign_agreement"),
        rate("_not_path", "n_benign", "benign_specificity"),
        "gross_discordances",
        rate("gross_discordances", "n", "gross_discordance_rate"),
    )


TIE = ["line_no", "alt_index"]


def planted_outcomes(answer_key: DataFrame, routed: DataFrame, tie: list[str] = TIE) -> DataFrame:
    """Where each labelled gene landed and the tier of its first reported call.

    Calls are reduced to one row per sample and gene before the join.
    """
    first = F.struct(*_order_values(tie))
    landed = routed.where(c("gene").isNotNull()).groupBy("sample_id", "gene").agg(
        F.min(outcome_rank()).alias("_rank"), F.min_by("tier", first).alias("tier")
    )
    names = F.array(*[F.lit(o) for o in OUTCOMES])
    return answer_key.join(landed, ["sample_id", "gene"], "left").select(
        *answer_key.columns,
        F.element_at(names, F.coalesce("_rank", F.lit(len(OUTCOMES)))).alias("outcome"),
        "tier",
    )


def _order_values(tie: list[str]) -> list[Column]:
    """Report order as ascending values, for use inside min_by."""
    return [
        tier_rank(c("tier")),
        F.when(asserts_pathogenic(c("clinvar_significance")), 0).otherwise(1),
        -F.coalesce("hpo_match_score", F.lit(0.0)),
        filter_frequency(c("gnomad_af"), c("abraom_af")),
        *[c(name) for name in tie],
    ]




def outcome_breakdown(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cases"))


def planted_ranks(answer_key: DataFrame, ranked: DataFrame, rank: str = "candidate_rank") -> DataFrame:
    """Best rank of each labelled gene among its sample's candidates; NULL when absent."""
    best = ranked.groupBy("sample_id", "gene").agg(F.min(rank).alias("best_rank"), F.count(F.lit(1)).alias("n_calls"))
    return answer_key.join(best, ["sample_id", "gene"], "left")


def decoy_pairs(cases: DataFrame, order: list[str], shift: int = 50) -> DataFrame:
    """Give case i the phenotype of case (i + shift) mod n."""
    n = cases.agg(F.count(F.lit(1))).scalar()
    numbered = position_in_group(cases, [], [c(o).asc() for o in order], "_at").withColumn("_at", c("_at") - 1)
    lent = numbered.select(F.pmod(c("_at") - shift, n).alias("_at"), c("sample_id").alias("decoy_sample_id"))
    return numbered.join(lent, "_at").drop("_at")


def case_signals(answer_key: DataFrame, routed: DataFrame) -> DataFrame:
    """Per labelled case: did the planted gene surface, and by which path."""
    pathogenic = is_pathogenic_tier(c("tier"))
    any_of = lambda test, name: F.coalesce(F.bool_or(test), F.lit(False)).alias(name)
    per_gene = routed.where(c("gene").isNotNull()).groupBy("sample_id", "gene").agg(
        any_of(pathogenic, "engine_plp"),
        any_of(pathogenic & (c("bucket") == "primary"), "pheno_primary"),
        any_of(c("not_to_dismiss"), "clinvar_flag"),
    )
    calls = routed.groupBy("sample_id").agg(F.count_if(pathogenic).alias("n_plp"))
    no = lambda name: F.coalesce(c(name), F.lit(False))
    joined = answer_key.join(per_gene, ["sample_id", "gene"], "left").join(calls, "sample_id", "left")
    filled = joined.withColumns(
        {
            "engine_plp": no("engine_plp"), "pheno_primary": no("pheno_primary"),
            "clinvar_flag": no("clinvar_flag"), "n_plp": F.coalesce("n_plp", F.lit(0)),
        }
    )
    engine = c("engine_plp") | c("pheno_primary")
    return filled.withColumns({"engine_only": engine, "surfaced": engine | c("clinvar_flag")})


def with_decoy_signals(answer_key: DataFrame, own: DataFrame, decoy: DataFrame) -> DataFrame:
    """Signals of every labelled case, and which of them it shows with a phenotype that is not its own.

    ``own`` and ``decoy`` are the routed findings of the two runs; the answer key has one row per sample.
    """
    lent = case_signals(answer_key, decoy).select(
        "sample_id", c("pheno_primary").alias("decoy_pheno_primary"), c("surfaced").alias("decoy_surfaced")
    )
    return case_signals(answer_key, own).join(lent, "sample_id")


def adversarial_summary(signals: DataFrame) -> DataFrame:
    """Rates over all cases (whole percent, rounded down) and over-call figures.

    The median takes the upper middle value. Needs ``decoy_pheno_primary`` and ``decoy_surfaced``
    beside the columns of :func:`case_signals` (:func:`with_decoy_signals`).
    """
    n = F.count(F.lit(1))
    names = ["surfaced", "engine_only", "engine_plp", "pheno_primary", "decoy_pheno_primary", "decoy_surfaced"]
    hits = [F.count_if(c(x)).alias(f"n_{x}") for x in names]
    percents = [F.floor(F.count_if(c(x)) * 100 / F.greatest(n, F.lit(1))).cast("bigint").alias(f"pct_{x}") for x in names]
    # percentile() interpolates. The window runs over one row per distinct count of calls.
    spread = signals.groupBy("n_plp").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.orderBy("n_plp").rowsBetween(Window.unboundedPreceding, 0)
    total = signals.agg(F.count(F.lit(1))).scalar()
    median = (
        spread.withColumn("seen", F.sum("m").over(upto))
        .where(c("seen") > F.floor(total / 2))
        .agg(F.min("n_plp").alias("over_call_median"))
    )
    summary = signals.agg(
        n.alias("n_cases"),
        *hits,
        *percents,
        F.count_if(c("clinvar_flag") & ~c("engine_only")).alias("n_only_clinvar_flag"),
        F.max("n_plp").alias("over_call_max"),
        F.min("n_plp").alias("over_call_min"),
    )
    return summary.withColumn("over_call_median", median.scalar())


def plan_modes(alleles: DataFrame) -> DataFrame:
    """Genotype plan per case: homozygous primary, a second allele, or one heterozygous allele.

    Needs ``case_id, is_primary, zygosity, allele_no`` and the locus of each allele.
    """
    other = F.struct("chrom", "pos", "ref", "alt", F.coalesce("zygosity", F.lit("het")).alias("zygosity"))
    per_case = alleles.groupBy("case_id").agg(
        F.min_by("zygosity", F.when(c("is_primary"), c("allele_no"))).alias("primary_zygosity"),
        F.min_by(F.when(~c("is_primary"), other), F.when(~c("is_primary"), c("allele_no"))).alias("second"),
    )
    hom = known(c("primary_zygosity").startswith("hom"))
    has_second = ~hom & c("second").isNotNull()
    return per_case.select(
        "case_id",
        F.when(hom, "hom").when(c("second").isNotNull(), "compound_het").otherwise("single_het").alias("mode"),
        *[F.when(has_second, c(f"second.{x}")).alias(f"second_{x}") for x in ("chrom", "pos", "ref", "alt", "zygosity")],
    )


def unused_cases(cases: DataFrame, used: DataFrame) -> DataFrame:
    """Cases whose gene and coordinate were both not used before; contigs match with or without prefix."""
    genes = used.select(F.upper("gene").alias("_gene")).distinct()
    loci = used.select(
        prefixed_contig(c("chrom")).alias("_chrom"), "pos", F.upper("ref").alias("_ref"), F.upper("alt").alias("_alt")
    ).distinct()
    fresh = cases.join(genes, F.upper(cases["gene"]) == c("_gene"), "left_anti")
    return fresh.join(
        loci,
        (prefixed_contig(fresh["chrom"]) == c("_chrom")) & (fresh["pos"] == loci["pos"])
        & (F.upper(fresh["ref"]) == c("_ref")) & (F.upper(fresh["alt"]) == c("_alt")),
        "left_anti",
    )


def consequence_distribution(cases: DataFrame) -> DataFrame:
    return cases.groupBy("consequence").agg(F.count(F.lit(1)).alias("n_cases"))


QUOTAS = {"missense_variant": 50, "inframe_indel": 15, "stop_gained": 13, "frameshift_variant": 15, "start_lost": 7}


def quota_selection(cases: DataFrame, quotas: dict[str, int] = QUOTAS, total: int = 100) -> DataFrame:
    """Up to each class's quota by gene order, then filled from the rest up to ``total``.

    Ranks stop at a known limit, so Spark trims every task before the shuffle.
    """
    largest = max(quotas.values())
    limit = reduce(lambda a, kv: F.when(c("consequence") == kv[0], kv[1]).otherwise(a), quotas.items(), F.lit(0))
    ranked = top_per_group(cases, ["consequence"], [c("gene").asc(), c("case_id").asc()], largest, "_rank")
    chosen = ranked.where(c("_rank") <= limit).drop("_rank").withColumn("by_quota", F.lit(True))
    rest = cases.join(chosen.select("case_id"), "case_id", "left_anti").withColumn("by_quota", F.lit(False))
    filler = rest.orderBy("case_no", "case_id").limit(total)
    return chosen.unionByName(filler).orderBy(c("by_quota").desc(), "case_no", "case_id").limit(total)


def stride_sample(rows: DataFrame, group: list[str], order: list[str], target: int, keep: Column) -> DataFrame:
    """Every k-th row of a group in order, with k chosen to leave about ``target``; ``keep`` rows stay."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    placed = position_in_group(rows, group, [c(o).asc() for o in order], "_at")
    stride = F.greatest(F.lit(1), F.floor(c("_n") / F.lit(max(1, target))))
    sized = placed.join(sizes, group) if group else placed.withColumn("_n", rows.agg(F.count(F.lit(1))).scalar())
    return sized.where(((c("_at") - 1) % stride == 0) | keep).drop("_at", "_n")


def new_panel_rows(existing: DataFrame, harvested: DataFrame) -> DataFrame:
    """Top-up: existing rows stay, only unseen keys are added."""
    return existing.unionByName(harvested.join(existing.select("key").distinct(), "key", "left_anti"))

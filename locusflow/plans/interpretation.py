"""Calls to routed, ranked findings for every sample in one job."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.keys import LOCUS, locus_from_key, with_locus
from locusflow.operators import evidence as ev
from locusflow.operators.bloom import WORTHWHILE_BYTES, planned_bytes, pruned
from locusflow.operators.combine import classify, explained
from locusflow.operators.durable import durable, stored
from locusflow.operators.phenotype import (
    ancestor_closure,
    information_content,
    inheritance_modes,
    phenotype_scores,
    sample_gene_pairs,
    with_phenotype,
)
from locusflow.operators.quality import passing_calls
from locusflow.operators.routing import rank_report, route
from locusflow.operators.selection import RANKED_ON, candidates, rank_candidates
from locusflow.settings import DEFAULTS, Thresholds
from locusflow.sources.vcf import parse_calls


@dataclass(frozen=True)
class Knowledge:
    """Reference tables of a run. Locus-keyed stores hold one row per locus."""

    frequency: DataFrame
    coverage: ev.Coverage
    assertions: DataFrame
    missense: DataFrame
    local_frequency: DataFrame
    predictors: DataFrame
    constraint: DataFrame
    haploinsufficient: DataFrame
    secondary_genes: DataFrame
    terms: DataFrame
    is_a: DataFrame
    gene_terms: DataFrame


def annotate(calls: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS, carried: bool = False) -> ev.LocusJoins:
    """Everything the rarity and impact filters need, for all calls given.

    One exchange of the calls serves every store. With ``carried``, evidence in
    INFO goes before store evidence.
    """
    joins = ev.LocusJoins(ev.flag_covered(calls, k.coverage), counted=calls)
    ev.join_frequency(joins, k.frequency)
    ev.join_assertions(joins, k.assertions)
    ev.join_local_frequency(joins, k.local_frequency)
    resolved = ev.resolve_frequency(joins.frame, k.coverage)
    joins.frame = _trusted(ev.prefer_carried(resolved) if carried else resolved)
    return joins


def _trusted(frame: DataFrame) -> DataFrame:
    """No coordinate evidence for calls from a file of another genome build, where the build is known."""
    return ev.trust_build(frame) if "build" in frame.columns else frame


def find_candidates(calls: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS, carried: bool = False) -> DataFrame:
    """Passing calls that are rare and have impact, with predictor scores added last.

    The missense and predictor joins come after the filter because only candidates use
    them; they still share the calls' partitioning.
    """
    joins = annotate(passing_calls(calls, t), k, t, carried)
    joins.frame = candidates(joins.frame, t)
    k = _near_candidates(joins, k)
    own = {x: joins.frame[x] for x in ("am_pathogenicity", "am_class", "revel", "cadd_phred") if x in joins.frame.columns}
    if own:
        return _trusted(_fill_predictors(joins, k))
    ev.join_missense(joins, k.missense)
    ev.join_predictors(joins, k.predictors)
    return _trusted(joins.done())


def _near_candidates(joins: ev.LocusJoins, k: Knowledge) -> Knowledge:
    """Knowledge whose late stores lack most loci that are no candidate's.

    Only stores whose shuffle costs more than writing the candidates once are pruned.
    """
    late = {"missense": with_locus(k.missense), "predictors": locus_from_key(k.predictors)}
    worth = {n: df for n, df in late.items() if planned_bytes(df) >= WORTHWHILE_BYTES}
    if not worth:
        return k
    joins.frame = stored(joins.frame)
    loci = joins.frame.select(*LOCUS)
    return replace(k, **{n: pruned(df, loci, LOCUS) for n, df in worth.items()})


def _fill_predictors(joins: ev.LocusJoins, k: Knowledge) -> DataFrame:
    """Store scores only where INFO carried none; REVEL and CADD change over together."""
    names = ("am_pathogenicity", "am_class", "revel", "cadd_phred")
    joins.frame = joins.frame.withColumnsRenamed({n: f"own_{n}" for n in names})
    ev.join_missense(joins, k.missense)
    ev.join_predictors(joins, k.predictors)
    keep_am = F.col("own_am_pathogenicity").isNotNull()
    keep_pair = F.col("own_revel").isNotNull() | F.col("own_cadd_phred").isNotNull()
    chosen = {n: F.when(keep_am if n.startswith("am_") else keep_pair, F.col(f"own_{n}")).otherwise(F.col(n)) for n in names}
    filled = joins.done().withColumns(chosen).drop(*[f"own_{n}" for n in names])
    if "evidence_source" not in filled.columns:
        return filled
    stored = {
        "missense": F.col("am_pathogenicity").isNotNull(),
        "insilico": F.col("revel").isNotNull() | F.col("cadd_phred").isNotNull(),
    }
    source = lambda name, held: F.when(
        (held == "none") & (((name == "missense") & stored["missense"]) | ((name == "insilico") & stored["insilico"])), "store"
    ).otherwise(held)
    return filled.withColumn("evidence_source", F.transform_values("evidence_source", source))


def with_gene_evidence(found: DataFrame, k: Knowledge) -> DataFrame:
    profile = ev.gene_profile(
        found, k.constraint, k.haploinsufficient, inheritance_modes(k.gene_terms), k.secondary_genes
    )
    return ev.with_gene_profile(found, profile)


def classify_candidates(
    found: DataFrame, patient_terms: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS, explain: bool = False
) -> DataFrame:
    """Gene and phenotype evidence for the candidates, then the five-tier call."""
    closure = ancestor_closure(k.terms, k.is_a)
    content = durable(information_content(k.terms, k.gene_terms, closure))
    return _judged(with_gene_evidence(found, k), patient_terms, k, closure, content, t, explain)


def _judged(profiled, patient_terms, k: Knowledge, closure, content, t: Thresholds, explain: bool = False) -> DataFrame:
    scores = phenotype_scores(sample_gene_pairs(profiled), patient_terms, k.gene_terms, closure, content, t)
    return classify(with_phenotype(profiled, scores), t, explain)


def ranked_candidates(
    found: DataFrame, patient_terms: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """``sample_id, line_no, alt_index``, those ``carried`` along and ``candidate_rank`` of every candidate.

    The order follows from frequency, assertion and phenotype score, so neither gene evidence nor
    criteria are worked out, and only the columns of the order are moved and sorted.
    """
    closure = ancestor_closure(k.terms, k.is_a)
    content = durable(information_content(k.terms, k.gene_terms, closure))
    scores = phenotype_scores(sample_gene_pairs(found), patient_terms, k.gene_terms, closure, content, t)
    scored = with_phenotype(found.select("sample_id", "gene", "line_no", "alt_index", *RANKED_ON), scores)
    narrow = scored.select("sample_id", "line_no", "alt_index", *carried, *RANKED_ON, "hpo_match_score")
    return rank_candidates(narrow).select("sample_id", "line_no", "alt_index", *carried, "candidate_rank")


def ranked_report(
    found: DataFrame, patient_terms: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS
) -> DataFrame:
    """``sample_id, line_no, alt_index`` and ``report_rank`` of every candidate.

    Every candidate is classified, but only its tier and the columns of the order are written, moved and sorted.
    """
    called = classify_candidates(found, patient_terms, k, t)
    narrow = stored(called.select("sample_id", "line_no", "alt_index", "tier", *RANKED_ON, "hpo_match_score"))
    return rank_report(narrow).select("sample_id", "line_no", "alt_index", "report_rank")


def with_lent_phenotypes(
    found: DataFrame, patient_terms: DataFrame, lent: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS,
    asked: DataFrame | None = None, columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Routed findings with each sample's own terms, and those it would have with another's.

    ``lent`` (sample_id, decoy_sample_id) has one row per sample. ``found`` is read twice, so it is
    best a stored table; only the phenotype step and what follows from it run twice. Findings with
    lent terms can be limited to the (sample_id, gene) that are ``asked`` for: routing looks at
    one sample's gene at a time, so these come out as they would among all. ``columns`` are those
    kept of a classified call, if not all are wanted; routing needs ``ROUTED_ON`` among them.
    """
    profiled = with_gene_evidence(found, k)
    closure = ancestor_closure(k.terms, k.is_a)
    content = durable(information_content(k.terms, k.gene_terms, closure))
    others = patient_terms.select(F.col("sample_id").alias("decoy_sample_id"), "term")
    borrowed = lent.select("sample_id", "decoy_sample_id").join(others, "decoy_sample_id").select("sample_id", "term")
    named = profiled if asked is None else profiled.join(asked.select("sample_id", "gene").distinct(), ["sample_id", "gene"], "left_semi")
    runs = (_judged(rows, terms, k, closure, content, t) for rows, terms in ((profiled, patient_terms), (named, borrowed)))
    own, decoy = (route(stored(judged.select(*columns) if columns else judged), t) for judged in runs)
    return own, decoy


def interpret(
    calls: DataFrame, patient_terms: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS,
    explain: bool = False, carried: bool = False,
) -> DataFrame:
    """Routed findings of all samples.

    Candidates feed several later aggregations, so they are written once, by column, after the
    big joins, and again after classification; the trail of ``explain`` is added after that.
    """
    found = stored(find_candidates(calls, k, t, carried))
    routed = route(stored(classify_candidates(found, patient_terms, k, t)), t)
    return explained(routed, t) if explain else routed


def interpret_text(
    lines: DataFrame, patient_terms: DataFrame, k: Knowledge, t: Thresholds = DEFAULTS, explain: bool = False,
    sample: str | None = None, all_samples: bool = False,
) -> DataFrame:
    """Routed findings straight from VCF lines (``file, line_no, value``).

    The text is parsed once and the calls are written, so that the passes that need a few
    columns of all calls read those columns only. Of joint files, carriers become calls.
    """
    calls = stored(parse_calls(lines, sample, all_samples, carriers_only=all_samples))
    return interpret(calls, patient_terms, k, t, explain, carried=True)

"""Queries on phenotype, criteria, combination, routing, exploration and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from locusflow.functions import keys as K
from locusflow.operators import combine as cb
from locusflow.operators import criteria as cr
from locusflow.operators import evaluation as evl
from locusflow.operators import explore as ex
from locusflow.operators import phenotype as ph
from locusflow.operators import quality as q
from locusflow.operators import routing as rt
from locusflow.operators import store_build as sb
from locusflow.operators import laid_store as ls
from locusflow.operators.durable import shared_path, stored
from locusflow.operators.evidence import LocusJoins
from locusflow.operators.health import readiness, store_measures, store_status
from locusflow.operators.selection import RANKED_ON
from locusflow.plans.interpretation import interpret_text, ranked_candidates, ranked_report, with_gene_evidence, with_lent_phenotypes
from locusflow.settings import DEFAULTS
from locusflow.workload.inputs import inputs
from locusflow.workload.oracle_steps import (
    BENIGN_AF,
    DECOYS,
    FILTER_AF,
    KEY,
    PLP_SIG,
    PLP_TIER,
    RELATED,
    stars,
)
from locusflow.workload.registry import STATEMENTS, query
from locusflow.workload.source_queries import stored_call_lines

c = F.col


def rows(name: str):
    return F.count(F.lit(1)).alias(name)


# --- ontology and phenotype --------------------------------------------------------
@query("AGG12_ancestor_closure", "SELECT term, ancestor FROM closure")
def _(spark, d):
    i = inputs(spark, d)
    return ph.ancestor_closure(i.relation("terms"), i.relation("is_a"))


@query("AGG13_information_content", "SELECT term, n_genes, ic FROM content")
def _(spark, d):
    return inputs(spark, d).content


@query(
    "AGG14_inheritance_modes",
    """SELECT ugene AS gene, concat_ws('+', CASE WHEN ad THEN 'AD' END, CASE WHEN ar THEN 'AR' END, CASE WHEN xl THEN 'XL' END) AS label
       FROM gene_modes WHERE ad OR ar OR xl""",
)
def _(spark, d):
    return ph.inheritance_modes(inputs(spark, d).relation("gene_terms")).select("gene", "label")


def _scores(i):
    return ph.phenotype_scores(
        ph.sample_gene_pairs(i.found), i.patient_terms, i.relation("gene_terms"), i.closure, i.content
    )


@query(
    "AGG10_matched_terms",
    """SELECT f.sample_id, f.gene, string_agg(p.term || '>' || b.gterm || ':' || CAST(round(b.sim * 100) AS INT), ',' ORDER BY p.term) AS matched
       FROM (SELECT DISTINCT sample_id, gene FROM found) f JOIN patient_terms p ON p.sample_id = f.sample_id JOIN best_pairs b ON b.gene = f.gene AND b.pterm = p.term
       WHERE b.sim >= 0.3 GROUP BY f.sample_id, f.gene""",
)
def _(spark, d):
    i = inputs(spark, d)
    found = ph.matched_terms(ph.sample_gene_pairs(i.found), i.patient_terms, i.relation("gene_terms"), i.closure, i.content)
    entry = lambda m: F.concat(m["term"], F.lit(">"), m["gene_term"], F.lit(":"), F.round(m["similarity"] * 100).cast("int").cast("string"))
    return found.select("sample_id", "gene", F.array_join(F.transform("matched_terms", entry), ",").alias("matched"))


@query(
    "AGG10_phenotype_score",
    "SELECT sample_id, gene, hpo_match_score, hpo_best_match, n_matched_terms::INT AS n_matched_terms FROM pheno WHERE hpo_best_match > 0",
)
def _(spark, d):
    return _scores(inputs(spark, d))


@query(
    "J10_term_matches",
    """SELECT f.sample_id, f.gene, p.term, round(b.sim, 6) AS similarity, b.gterm AS gene_term, count(*) AS n
       FROM (SELECT DISTINCT sample_id, gene FROM found) f JOIN patient_terms p ON p.sample_id = f.sample_id
       JOIN best_pairs b ON b.gene = f.gene AND b.pterm = p.term GROUP BY ALL""",
)
def _(spark, d):
    i = inputs(spark, d)
    matches = ph.term_matches(
        ph.sample_gene_pairs(i.found), i.patient_terms, i.relation("gene_terms"), i.closure, i.content
    )
    return matches.groupBy("sample_id", "gene", "term", F.round("similarity", 6).alias("similarity"), "gene_term").agg(rows("n"))


@query("W10_distinct_pair_similarity", "SELECT gene, pterm AS term, round(sim, 6) AS similarity, gterm AS gene_term FROM best_pairs")
def _(spark, d):
    i = inputs(spark, d)
    genes = i.relation("phenotype_terms")
    terms = i.patient_terms.select("term").distinct()
    # Every (gene, patient term) pair with a shared informative ancestor, found through the ancestors,
    # and every pair whose term the gene itself has, which may carry no information.
    above = i.closure.join(i.content.where(c("ic") > 0).select(c("term").alias("ancestor")), "ancestor")
    reach = genes.join(above, "term").select("gene", "ancestor").distinct()
    related = terms.join(above, "term").join(reach, "ancestor").select("gene", "term")
    pairs = related.union(genes.join(terms, "term", "left_semi").select("gene", "term")).distinct()
    best = ph.best_matches(pairs, genes, i.closure, i.content)
    return best.select("gene", "term", F.round("similarity", 6).alias("similarity"), "gene_term")


@query(
    "AGG11_overlap_score",
    """SELECT f.sample_id, f.gene, round(count(*) / max(n.n), 3) AS hpo_match_score, 1.0::DOUBLE AS hpo_best_match, count(*)::INT AS n_matched_terms
       FROM (SELECT DISTINCT sample_id, gene FROM found) f JOIN (SELECT DISTINCT sample_id, term FROM patient_terms) p USING (sample_id)
       JOIN (SELECT sample_id, count(DISTINCT term) AS n FROM patient_terms GROUP BY sample_id) n USING (sample_id)
       JOIN phenotype_terms g ON g.gene = f.gene AND g.term = p.term GROUP BY f.sample_id, f.gene""",
)
def _(spark, d):
    i = inputs(spark, d)
    return ph.overlap_scores(ph.sample_gene_pairs(i.found), i.patient_terms, i.relation("gene_terms"))


@query(
    "SET3_shared_terms",
    """SELECT p.sample_id, count(*) AS n_shared FROM (SELECT DISTINCT sample_id, term FROM patient_terms) p
       WHERE term IN (SELECT term FROM phenotype_terms) GROUP BY p.sample_id""",
)
def _(spark, d):
    i = inputs(spark, d)
    shared = i.patient_terms.distinct().join(i.relation("phenotype_terms").select("term").distinct(), "term", "left_semi")
    return shared.groupBy("sample_id").agg(rows("n_shared"))


# --- criteria and combination --------------------------------------------------------
_CODES = {
    "CR1_PVS1": "PVS1", "CR7_PM2": "PM2", "CR9_PM4": "PM4", "CR13_PP3": "PP3", "CR14_PP4": "PP4", "CR15_PP5": "PP5",
    "CR16_BA1": "BA1", "CR17_BS1": "BS1", "CR18_BS2": "BS2", "CR19_BP4": "BP4", "CR20_BP6": "BP6", "CR21_BP7": "BP7",
}


def _register_criterion(name: str, code: str) -> None:
    @query(name, f"SELECT sample_id, line_no, s_{code} AS strength FROM strengths")
    def _(spark, d):
        from locusflow.operators.evidence import gene_profile, with_gene_profile

        i = inputs(spark, d)
        k = i.knowledge
        profile = gene_profile(i.found, k.constraint, k.haploinsufficient, ph.inheritance_modes(k.gene_terms), k.secondary_genes)
        ready = with_gene_profile(i.found, profile)
        if code == "PP4":
            ready = ph.with_phenotype(ready, _scores(i))
        return cr.with_inputs(ready).select("sample_id", "line_no", cr.DECIDED[code](DEFAULTS).alias("strength"))


for _name, _code in _CODES.items():
    _register_criterion(_name, _code)


@query(
    "CR_all_trail",
    """SELECT code, count(*) AS n, count(*) FILTER (WHERE met) AS n_met, count(*) FILTER (WHERE code NOT IN ('PS2', 'PM3', 'PM6')) AS n_applies,
         count(*) FILTER (WHERE code IN ('PS1', 'PS3', 'PS4', 'PM1', 'PM5', 'PP2')) AS n_left_to_expert FROM (
       SELECT unnest(['PVS1','PS1','PS2','PS3','PS4','PM1','PM2','PM3','PM4','PM5','PM6','PP2','PP3','PP4','PP5','BA1','BS1','BS2','BP4','BP6','BP7']) AS code,
         unnest([s_PVS1 IS NOT NULL,false,false,false,false,false,s_PM2 IS NOT NULL,false,s_PM4 IS NOT NULL,false,false,false,s_PP3 IS NOT NULL,
           s_PP4 IS NOT NULL,s_PP5 IS NOT NULL,s_BA1 IS NOT NULL,s_BS1 IS NOT NULL,s_BS2 IS NOT NULL,s_BP4 IS NOT NULL,s_BP6 IS NOT NULL,s_BP7 IS NOT NULL]) AS met
       FROM strengths) x GROUP BY code""",
)
def _(spark, d):
    """CR2-CR6, CR8, CR10-CR12 and the decided codes: the full 21-row trail of every candidate."""
    called = cb.explained(inputs(spark, d).classified(), fields=["code", "met", "applies", "adjudicated_by"])
    trail = ex.criterion_rows(called)
    return trail.groupBy("code").agg(
        rows("n"), F.count_if("met").alias("n_met"), F.count_if("applies").alias("n_applies"),
        F.count_if(c("adjudicated_by") == "model").alias("n_left_to_expert"),
    )


@query("CB1_evidence_counts", "SELECT sample_id, line_no, pvs, ps, pm, pp, ba, bs, bp FROM counted")
def _(spark, d):
    graded = cr.with_strengths(inputs(spark, d).classified())
    return graded.select("sample_id", "line_no", *[v.alias(n) for n, v in cb.evidence_counts(cr.earned()).items()])


@query("CB2_CB3_CB4_rule_labels", "SELECT sample_id, line_no, l_path, l_lp, l_ben, l_lb FROM labelled")
def _(spark, d):
    graded = cr.with_strengths(inputs(spark, d).classified())
    counted = graded.select("sample_id", "line_no", *[v.alias(n) for n, v in cb.evidence_counts(cr.earned()).items()])
    n = {name: c(name) for name in cb.COUNTERS}
    return counted.select(
        "sample_id", "line_no", cb.pathogenic_label(n).alias("l_path"), cb.likely_pathogenic_label(n).alias("l_lp"),
        cb.benign_label(n).alias("l_ben"), cb.likely_benign_label(n).alias("l_lb"),
    )


@query("CB5_tier_and_rule_path", "SELECT sample_id, line_no, tier, rule_path FROM classified")
def _(spark, d):
    return inputs(spark, d).classified().select("sample_id", "line_no", "tier", "rule_path")


@query(
    "CB6_points_model",
    """SELECT sample_id, line_no, tier2 AS tier, CASE WHEN met_text = '' THEN 'no criteria met' ELSE met_text END || ' => ' || CASE WHEN points >= 0 THEN '+' ELSE '' END || points || ' points (ClinGen/Tavtigian) => ' || tier2 AS rule_path
       FROM (SELECT *, CASE WHEN points >= 10 THEN 'Pathogenic' WHEN points >= 6 THEN 'Likely Pathogenic' WHEN points >= 0 THEN 'Uncertain Significance (VUS)'
         WHEN points >= -6 THEN 'Likely Benign' ELSE 'Benign' END AS tier2 FROM counted) x""",
)
def _(spark, d):
    given = inputs(spark, d).classified().drop("tier", "rule_path", "met_codes")
    return cb.classify(given, replace(DEFAULTS, model="clingen")).select("sample_id", "line_no", "tier", "rule_path")


@query(
    "CB7_pm2_moderate",
    """SELECT tier, count(*) AS n FROM (SELECT CASE WHEN (pvs >= 1 AND (ps >= 1 OR pm2 >= 2 OR (pm2 = 1 AND pp2 >= 1) OR pp2 >= 2)) OR ps >= 2
           OR (ps = 1 AND (pm2 >= 3 OR (pm2 >= 2 AND pp2 >= 2) OR (pm2 = 1 AND pp2 >= 4))) THEN CASE WHEN b THEN 'V' ELSE 'Pathogenic' END
         WHEN (pvs >= 1 AND (pm2 >= 1 OR pp2 >= 1)) OR (ps = 1 AND pm2 IN (1, 2)) OR (ps = 1 AND pp2 >= 2) OR pm2 >= 3 OR (pm2 >= 2 AND pp2 >= 2) OR (pm2 = 1 AND pp2 >= 4)
           THEN CASE WHEN b THEN 'V' ELSE 'Likely Pathogenic' END
         WHEN l_ben IS NOT NULL THEN 'Benign' WHEN l_lb IS NOT NULL THEN 'Likely Benign' ELSE 'V' END AS t
       FROM (SELECT *, pm + CASE WHEN s_PM2 IS NOT NULL THEN 1 ELSE 0 END AS pm2, pp - CASE WHEN s_PM2 IS NOT NULL THEN 1 ELSE 0 END AS pp2,
         coalesce(l_ben, l_lb) IS NOT NULL AS b FROM labelled) x) y, (VALUES ('V', 'Uncertain Significance (VUS)'), ('Pathogenic', 'Pathogenic'),
         ('Likely Pathogenic', 'Likely Pathogenic'), ('Benign', 'Benign'), ('Likely Benign', 'Likely Benign')) v(short, tier) WHERE t = short GROUP BY tier""",
)
def _(spark, d):
    given = inputs(spark, d).classified().drop("tier", "rule_path", "met_codes")
    return cb.classify(given, replace(DEFAULTS, pm2_strength="moderate")).groupBy("tier").agg(rows("n"))


@query("CB8_met_codes", "SELECT sample_id, line_no, met_text AS met_codes FROM classified")
def _(spark, d):
    return inputs(spark, d).classified().select("sample_id", "line_no", F.array_join("met_codes", " + ").alias("met_codes"))


@query("CB9_classify_all", "SELECT tier, count(*) AS n, count(DISTINCT gene) AS n_genes, round(avg(hpo_match_score), 6) AS score FROM classified GROUP BY tier")
def _(spark, d):
    from locusflow.plans.interpretation import classify_candidates

    i = inputs(spark, d)
    called = classify_candidates(i.found, i.patient_terms, i.knowledge)
    return called.groupBy("tier").agg(rows("n"), F.countDistinct("gene").alias("n_genes"), F.round(F.avg("hpo_match_score"), 6).alias("score"))


@query("AGG17_pathogenic_hits", "SELECT sample_id, gene, n_pathogenic FROM hits")
def _(spark, d):
    return rt.pathogenic_hits(inputs(spark, d).classified())


# --- routing ---------------------------------------------------------------------------
_KEYS = ["sample_id", "line_no"]


@query("RT1_finding_buckets", "SELECT sample_id, line_no, bucket FROM routed")
def _(spark, d):
    return inputs(spark, d).routed().select(*_KEYS, "bucket")


@query("ALL_text_to_findings", "SELECT sample_id, line_no, gene, tier, rule_path, bucket, carrier, probable_vus FROM text_routed")
def _(spark, d):
    i = inputs(spark, d)
    found = interpret_text(stored_call_lines(i), i.patient_terms, i.knowledge)
    return found.select(*_KEYS, "gene", "tier", "rule_path", "bucket", "carrier", "probable_vus")


@query("RT2_carriers", "SELECT sample_id, line_no FROM routed WHERE carrier")
def _(spark, d):
    return inputs(spark, d).routed().where("carrier").select(*_KEYS)


@query("RT3_absent_homozygotes", "SELECT sample_id, line_no, artifact AS absent_homozygote FROM routed")
def _(spark, d):
    return inputs(spark, d).routed().select(*_KEYS, "absent_homozygote")


@query(
    "RT4_not_to_dismiss",
    f"""SELECT sample_id, gene, {KEY} AS variant, hgvs_p AS hgvs, tier AS engine_tier, clinvar_significance, clinvar_review_status,
        {stars('clinvar_review_status')} AS clinvar_stars, clinvar_accession FROM routed WHERE dismissable""",
)
def _(spark, d):
    return rt.not_to_dismiss(inputs(spark, d).routed())


@query(
    "RT5_triage_signals",
    f"""SELECT sample_id, line_no, concat_ws(', ', CASE WHEN am_pathogenicity >= 0.564 THEN 'AlphaMissense likely-pathogenic' WHEN am_pathogenicity >= 0.34 THEN 'AlphaMissense ambiguous' END,
        CASE WHEN {RELATED} THEN 'phenotype match' END, CASE WHEN lower(clinvar_significance) LIKE '%conflict%' THEN 'ClinVar conflicting'
        WHEN lower(clinvar_significance) LIKE '%pathogenic%' THEN 'ClinVar Pathogenic assertion' END, CASE WHEN lof_intolerant THEN 'LoF-intolerant gene' END) AS signals,
        molecular + CASE WHEN {RELATED} THEN 2 ELSE 0 END AS score FROM routed""",
)
def _(spark, d):
    names = F.array_join(F.transform(rt.signals(), lambda s: s["signal"]), ", ")
    return inputs(spark, d).routed().select(*_KEYS, names.alias("signals"), rt.triage_score().alias("score"))


@query("RT6_probable_vus", "SELECT sample_id, line_no FROM routed WHERE probable_vus")
def _(spark, d):
    return inputs(spark, d).routed().where("probable_vus").select(*_KEYS)


@query(
    "RT7_exploration_notes",
    f"""SELECT sample_id, line_no, gene || ' ' || hgvs_p || ' — VUS with ' || concat_ws(', ', CASE WHEN am_pathogenicity >= 0.564 THEN 'AlphaMissense likely-pathogenic' WHEN am_pathogenicity >= 0.34 THEN 'AlphaMissense ambiguous' END,
        'phenotype match', CASE WHEN lower(clinvar_significance) LIKE '%conflict%' THEN 'ClinVar conflicting'
        WHEN lower(clinvar_significance) LIKE '%pathogenic%' THEN 'ClinVar Pathogenic assertion' END, CASE WHEN lof_intolerant THEN 'LoF-intolerant gene' END) AS note FROM routed WHERE probable_vus""",
)
def _(spark, d):
    vus = inputs(spark, d).routed().where("probable_vus")
    return rt.exploration_notes(vus).select(*_KEYS, "note")


_VUS_ORDER = "molecular DESC, CASE WHEN {p} THEN 0 ELSE 1 END, hpo_match_score DESC, {f}, line_no, alt_index".format(p=PLP_SIG, f=FILTER_AF)


@query(
    "W3_vus_ranking",
    f"SELECT sample_id, line_no, row_number() OVER (PARTITION BY sample_id ORDER BY {_VUS_ORDER}) AS vus_rank FROM routed WHERE probable_vus",
)
def _(spark, d):
    narrow = inputs(spark, d).routed().select(*_KEYS, "alt_index", "probable_vus", "triage_score", *RANKED_ON, "hpo_match_score")
    return rt.rank_probable_vus(narrow).select(*_KEYS, "vus_rank")


@query(
    "W4_top_vus",
    f"SELECT * FROM (SELECT sample_id, line_no, row_number() OVER (PARTITION BY sample_id ORDER BY {_VUS_ORDER}) AS vus_rank FROM routed WHERE probable_vus) x WHERE vus_rank <= 3",
)
def _(spark, d):
    return rt.top_probable_vus(inputs(spark, d).routed()).select(*_KEYS, "vus_rank")


@query("W1_candidate_ranking", "SELECT sample_id, line_no, candidate_rank FROM ranked")
def _(spark, d):
    i = inputs(spark, d)
    return ranked_candidates(i.found, i.patient_terms, i.knowledge).select(*_KEYS, "candidate_rank")


@query(
    "W2_report_order",
    "SELECT sample_id, line_no, row_number() OVER (PARTITION BY sample_id ORDER BY tier_no, candidate_rank) AS report_rank FROM tier_order",
)
def _(spark, d):
    i = inputs(spark, d)
    return ranked_report(i.found, i.patient_terms, i.knowledge).select(*_KEYS, "report_rank")


@query(
    "RT8_conclusions",
    f"""SELECT sample_id, n AS section_no, gene, detail FROM (
      SELECT sample_id, 1 AS n, gene, tier AS detail FROM routed WHERE bucket = 'primary' AND {PLP_TIER}
      UNION ALL SELECT m.sample_id, 2, NULL, coalesce(u, 0) || ' uncertain' FROM (SELECT sample_id, round(median(depth), 1) AS med FROM calls GROUP BY sample_id) m
        LEFT JOIN (SELECT sample_id, count(*) FILTER (WHERE bucket = 'primary' AND {PLP_TIER}) AS dx, count(*) FILTER (WHERE bucket = 'primary' AND tier = 'Uncertain Significance (VUS)') AS u
          FROM routed GROUP BY sample_id) r ON m.sample_id = r.sample_id WHERE coalesce(dx, 0) = 0
      UNION ALL SELECT sample_id, 3, gene, tier FROM routed WHERE dismissable
      UNION ALL SELECT sample_id, 4, gene, tier FROM routed WHERE artifact AND {PLP_TIER}
      UNION ALL SELECT sample_id, 5, gene, tier FROM routed WHERE bucket = 'secondary' AND {PLP_TIER}
      UNION ALL SELECT sample_id, 6, gene, tier FROM routed WHERE carrier
      UNION ALL SELECT sample_id, 7, gene, tier FROM routed WHERE bucket = 'other' AND {PLP_TIER} AND NOT carrier
      UNION ALL SELECT sample_id, 8, gene, concat_ws(', ', CASE WHEN am_pathogenicity >= 0.564 THEN 'AlphaMissense likely-pathogenic' WHEN am_pathogenicity >= 0.34 THEN 'AlphaMissense ambiguous' END,
          'phenotype match', CASE WHEN lower(clinvar_significance) LIKE '%conflict%' THEN 'ClinVar conflicting' WHEN lower(clinvar_significance) LIKE '%pathogenic%' THEN 'ClinVar Pathogenic assertion' END,
          CASE WHEN lof_intolerant THEN 'LoF-intolerant gene' END)
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {_VUS_ORDER}) AS rn FROM routed WHERE probable_vus) v WHERE rn <= 3
      UNION ALL SELECT sample_id, 9, NULL, 'median ' || med FROM (SELECT sample_id, round(median(depth), 1) AS med FROM calls GROUP BY sample_id) m
      UNION ALL SELECT DISTINCT sample_id, 10, NULL, 'PS2, PM3, PM6, PP1, BS4 not assessed' FROM calls
      UNION ALL SELECT DISTINCT sample_id, 11, NULL, 'expert review and orthogonal confirmation' FROM calls) z""",
)
def _(spark, d):
    i = inputs(spark, d)
    return rt.conclusion_items(i.routed(), q.sequencing_quality(i.calls)).drop("section")


_SECTION = """CASE section_no WHEN 1 THEN 'diagnosis' WHEN 2 THEN 'no pathogenic finding' WHEN 3 THEN 'do not dismiss' WHEN 4 THEN 'verify genotype'
  WHEN 5 THEN 'secondary finding' WHEN 6 THEN 'carrier' WHEN 7 THEN 'other pathogenic' WHEN 8 THEN 'probable pathogenic VUS'
  WHEN 9 THEN CASE WHEN CAST(replace(detail, 'median ', '') AS DOUBLE) < 20 THEN 'coverage limitation' ELSE 'depth adequate' END
  WHEN 10 THEN 'single proband' ELSE 'next steps' END"""
_PART = 40
_IN = {
    "primary": "bucket = 'primary'", "secondary": "bucket = 'secondary'", "carrier": "carrier", "probable_pathogenic_vus": "probable_vus", "other": "bucket = 'other'",
}
_PARTS_SQL = f"""(SELECT coalesce(f.sample_id, k.sample_id) AS sample_id, coalesce(f.part, k.part) AS part, coalesce(f.n, 0) AS n_findings, coalesce(flags, '') AS flags, coalesce(conclusion, '') AS conclusion,
    {", ".join(f"coalesce(in_{b}, '') AS in_{b}" for b in _IN)}, coalesce(lines, '') AS lines
  FROM (SELECT sample_id, (rn - 1) // {_PART} AS part, count(*) AS n, string_agg(gene, ',' ORDER BY rn) FILTER (WHERE dismissable) AS flags,
      string_agg(line_no || ':' || tier, ',' ORDER BY rn) AS lines, {", ".join(f"string_agg(gene, ',' ORDER BY rn) FILTER (WHERE {test}) AS in_{b}" for b, test in _IN.items())}
    FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line_no, alt_index, gene) AS rn FROM routed) r GROUP BY 1, 2) f
  FULL JOIN (SELECT sample_id, (rn - 1) // {_PART} AS part, string_agg({_SECTION} || ':' || coalesce(gene, '') || ':' || coalesce(detail, ''), ',' ORDER BY rn) AS conclusion
    FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY section_no, gene NULLS FIRST, detail NULLS FIRST) AS rn FROM (CONCLUSIONS) a) b GROUP BY 1, 2) k
  ON f.sample_id = k.sample_id AND f.part = k.part)""".replace("CONCLUSIONS", STATEMENTS["RT8_conclusions"])
_HEADER = "LEFT JOIN (SELECT sample_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM patient_terms GROUP BY sample_id) t ON t.sample_id = p.sample_id LEFT JOIN (SELECT sample_id, count(*) AS n FROM routed GROUP BY sample_id) n ON n.sample_id = p.sample_id"


def _documents(i):
    conclusions = rt.conclusion_items(i.routed(), q.sequencing_quality(i.calls))
    return i.keep("documents", lambda: ex.sample_documents(i.routed(), conclusions, i.patient_terms, _PART))


@query(
    "SNK5_sample_documents",
    f"""SELECT p.*, coalesce(terms, '') AS hpo_terms, coalesce(n.n, 0) AS n_candidates FROM {_PARTS_SQL} p {_HEADER}""",
)
def _(spark, d):
    text = lambda x: F.array_join(x, ",")
    item = lambda s: F.concat_ws(":", s["section"], F.coalesce(s["gene"], F.lit("")), F.coalesce(s["detail"], F.lit("")))
    return _documents(inputs(spark, d)).select(
        "sample_id", "part", "n_findings", "n_candidates", text(c("hpo_terms")).alias("hpo_terms"),
        text(F.transform("not_to_dismiss", lambda x: x["gene"])).alias("flags"), text(F.transform("conclusion", item)).alias("conclusion"),
        *[text(c(f"buckets.{b}")).alias(f"in_{b}") for b in _IN],
        text(F.transform("findings", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["tier"]))).alias("lines"),
    )


@query(
    "Q1_case_digest",
    f"""SELECT p.sample_id, coalesce(any_value(terms), '') AS hpo_terms, coalesce(any_value(n.n), 0) AS n_candidates, min_by(p.conclusion, p.part) AS conclusion,
        {", ".join(f"sum(len(list_filter(string_split(in_{b}, ','), lambda g: g <> '')))::BIGINT AS n_{b}" for b in _IN)}, sum(len(list_filter(string_split(flags, ','), lambda g: g <> '')))::BIGINT AS n_not_to_dismiss
        FROM {_PARTS_SQL} p {_HEADER} GROUP BY p.sample_id""",
)
def _(spark, d):
    item = lambda s: F.concat_ws(":", s["section"], F.coalesce(s["gene"], F.lit("")), F.coalesce(s["detail"], F.lit("")))
    digest = ex.overview(_documents(inputs(spark, d))).drop("build")
    return digest.withColumns(
        {"hpo_terms": F.array_join("hpo_terms", ","), "conclusion": F.array_join(F.transform("conclusion", item), ",")}
    )


# --- exploration -------------------------------------------------------------------------
@query(
    "Q1_case_overview",
    """SELECT sample_id, count(*) AS n_candidates, count(*) FILTER (WHERE bucket = 'primary') AS n_primary, count(*) FILTER (WHERE bucket = 'secondary') AS n_secondary,
       count(*) FILTER (WHERE carrier) AS n_carrier, count(*) FILTER (WHERE probable_vus) AS n_probable_pathogenic_vus,
       count(*) FILTER (WHERE bucket = 'other') AS n_other, count(*) FILTER (WHERE dismissable) AS n_not_to_dismiss FROM routed GROUP BY sample_id""",
)
def _(spark, d):
    return ex.case_overview(inputs(spark, d).routed())


@query("Q2_gene_findings", "SELECT sample_id, line_no, tier FROM routed WHERE upper(gene) = 'GENE9'")
def _(spark, d):
    return ex.findings_for_gene(inputs(spark, d).routed(), "gene9").select(*_KEYS, "tier")


@query(
    "Q3_bucket_by_gene",
    "SELECT sample_id, line_no, bucket FROM routed r WHERE EXISTS (SELECT 1 FROM routed o WHERE o.sample_id = r.sample_id AND o.gene = r.gene AND o.bucket = 'secondary')",
)
def _(spark, d):
    return ex.variants_in_bucket(inputs(spark, d).routed(), "secondary").select(*_KEYS, "bucket")


@query("Q3_bucket_exact", "SELECT sample_id, line_no FROM routed WHERE carrier")
def _(spark, d):
    return ex.variants_in_bucket(inputs(spark, d).routed(), "carrier", by_gene=False).select(*_KEYS)


@query(
    "Q4_criterion_basis",
    f"SELECT sample_id, {KEY} AS variant, tier, s_PM2 IS NOT NULL AS met, coalesce(s_PM2, 'moderate') AS strength, count(*) AS n FROM classified WHERE gene = 'GENE9' GROUP BY ALL",
)
def _(spark, d):
    called = cb.explained(inputs(spark, d).classified(), fields=["code", "met", "default_strength", "applied_strength"])
    basis = ex.criterion_basis(called, "gene9", "pm2")
    return basis.groupBy("sample_id", "variant", "tier", "met", "strength").agg(rows("n"))


@query(
    "Q5_resting_on_assertions",
    f"""SELECT sample_id, variant, tier, code, count(*) AS n FROM (SELECT sample_id, {KEY} AS variant, tier, 'PP5' AS code FROM classified WHERE s_PP5 IS NOT NULL
        UNION ALL SELECT sample_id, {KEY}, tier, 'BP6' FROM classified WHERE s_BP6 IS NOT NULL) x GROUP BY ALL""",
)
def _(spark, d):
    found = ex.findings_resting_on_assertions(cb.explained(inputs(spark, d).classified(), fields=["code", "met", "citation"]))
    return found.groupBy("sample_id", "variant", "tier", "code").agg(rows("n"))


@query(
    "Q6_gene_digest",
    """SELECT r.sample_id, hgvs_p, tier, rule_path, replace(met_text, ' + ', ' ') AS met_codes, buckets, count(*) AS n FROM routed r LEFT JOIN (
         SELECT sample_id, string_agg(b, ',' ORDER BY b) AS buckets FROM (SELECT DISTINCT sample_id, b FROM (
           SELECT sample_id, unnest([bucket, CASE WHEN carrier THEN 'carrier' END, CASE WHEN probable_vus THEN 'probable_pathogenic_vus' END]) AS b FROM routed WHERE gene = 'GENE9') y
         WHERE b IS NOT NULL) x GROUP BY sample_id) m ON m.sample_id = r.sample_id WHERE gene = 'GENE9' GROUP BY ALL""",
)
def _(spark, d):
    digest = ex.gene_digest(inputs(spark, d).routed(), "GENE9")
    return digest.groupBy("sample_id", "hgvs_p", "tier", "rule_path", "met_codes", "buckets").agg(rows("n"))


@query(
    "Q7_findings_table",
    f"""SELECT sample_id, gene, {KEY} AS variant, hgvs_p AS hgvs, consequence, zygosity, tier, replace(met_text, ' + ', ' ') AS met_codes, bucket,
        round(gnomad_af, 9) AS gnomad_af, clinvar_significance, hpo_match_score FROM routed""",
)
def _(spark, d):
    return ex.findings_table(inputs(spark, d).routed()).withColumn("gnomad_af", F.round("gnomad_af", 9))


@query(
    "Q8_adhoc_classification",
    f"""SELECT key, CASE WHEN pvs + bs = 0 AND ba = 0 THEN 'none' ELSE 'some' END AS strong_evidence FROM (
          SELECT key, CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'start_lost') AND false THEN 1 ELSE 0 END AS pvs,
            CASE WHEN coalesce(faf95, af) >= 0.05 THEN 1 ELSE 0 END AS ba,
            CASE WHEN hom >= 2 OR (coalesce(faf95, af) >= 0.005 AND coalesce(faf95, af) < 0.05) THEN 1 ELSE 0 END AS bs
          FROM panel JOIN frozen_freq USING (key)) x""",
)
def _(spark, d):
    i = inputs(spark, d)
    given = i.relation("panel").join(i.relation("frozen_freq"), "key").select(
        "key", "gene", "consequence", c("af").alias("gnomad_af"), c("faf95").alias("gnomad_faf95"), c("hom").alias("gnomad_homozygotes")
    )
    called = cb.classify(given)
    strong = F.arrays_overlap("met_codes", F.array(*[F.lit(x) for x in ("PVS1", "BA1", "BS1", "BS2")]))
    return called.select("key", F.when(strong, "some").otherwise("none").alias("strong_evidence"))


# --- evaluation ----------------------------------------------------------------------------
def _panel_rows(i):
    entries = evl.panel_entries(
        i.relation("panel"), i.relation("frozen_freq"),
        i.knowledge.missense.select(K.variant_key().alias("key"), "am_pathogenicity", "am_class"),
    )
    return evl.panel_rows(cb.classify(evl.withhold_assertions(with_gene_evidence(entries, i.knowledge))))


_PANEL = """(SELECT *, CASE WHEN p AND b THEN 'VUS' WHEN p THEN 'PATH' WHEN b THEN 'BEN' ELSE 'VUS' END AS engine FROM (
  SELECT *, (pvs >= 1 AND (ps >= 1 OR pm >= 1 OR pp >= 1)) OR (ps = 1 AND pm IN (1, 2)) OR (ps = 1 AND pp >= 2) OR pm >= 3 OR (pm >= 2 AND pp >= 2) AS p,
    ba >= 1 OR bs >= 2 OR (bs = 1 AND bp >= 1) OR bp >= 2 AS b FROM (
    SELECT key, truth, nullv, CASE WHEN nullv AND (lof OR hi OR ar) THEN 1 ELSE 0 END AS pvs,
      CASE WHEN am >= 0.99 THEN 1 ELSE 0 END AS ps, CASE WHEN am >= 0.9 AND am < 0.99 THEN 1 ELSE 0 END + CASE WHEN consequence = 'inframe_deletion' THEN 1 ELSE 0 END AS pm,
      CASE WHEN am >= 0.564 AND am < 0.9 THEN 1 ELSE 0 END + CASE WHEN af <= CASE WHEN ad OR xl THEN 1e-4 WHEN ar THEN 1e-3 ELSE 1e-4 END THEN 1 ELSE 0 END AS pp,
      CASE WHEN coalesce(faf95, af) >= 0.05 THEN 1 ELSE 0 END AS ba,
      CASE WHEN hom >= 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(faf95, af) >= CASE WHEN ar THEN 0.01 WHEN ad OR xl THEN 0.001 ELSE 0.005 END AND coalesce(faf95, af) < 0.05 THEN 1 ELSE 0 END AS bs,
      CASE WHEN am <= 0.34 THEN 1 ELSE 0 END + CASE WHEN consequence = 'synonymous_variant' THEN 1 ELSE 0 END AS bp
    FROM (SELECT p.key, CASE WHEN p.clinvar_significance IN ('Pathogenic', 'Likely pathogenic') THEN 'PATH' ELSE 'BEN' END AS truth, p.consequence,
        p.consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'start_lost') AS nullv,
        coalesce(k.pli >= 0.9, false) OR coalesce(k.loeuf < 0.35, false) AS lof, f.af, f.faf95, f.hom, s.am_pathogenicity AS am,
        upper(p.gene) IN (SELECT upper(gene) FROM haploinsufficient) AS hi, coalesce(m.ad, false) AS ad, coalesce(m.ar, false) AS ar, coalesce(m.xl, false) AS xl
      FROM panel p JOIN frozen_freq f ON f.key = p.key LEFT JOIN gene_constraint k ON k.gene = p.gene LEFT JOIN gene_modes m ON m.ugene = upper(p.gene)
      LEFT JOIN (SELECT replace(chrom, 'chr', '') || '-' || pos || '-' || ref || '-' || alt AS key, am_pathogenicity FROM score_store) s ON s.key = p.key
      WHERE p.clinvar_significance <> 'Uncertain significance') a) b) c)"""


@query("J12_panel_calls", f"SELECT key, truth AS truth_class, engine AS engine_class, truth = engine AS concordant FROM {_PANEL} z")
def _(spark, d):
    return _panel_rows(inputs(spark, d)).select("key", "truth_class", "engine_class", "concordant")


@query(
    "AGG18_confusion_matrix",
    f"""SELECT t.truth, count(z.key) FILTER (WHERE engine = 'PATH') AS called_path, count(z.key) FILTER (WHERE engine = 'VUS') AS called_vus,
        count(z.key) FILTER (WHERE engine = 'BEN') AS called_ben FROM (VALUES ('PATH'), ('VUS'), ('BEN')) t(truth) LEFT JOIN {_PANEL} z ON z.truth = t.truth GROUP BY t.truth""",
)
def _(spark, d):
    return evl.confusion_matrix(_panel_rows(inputs(spark, d)))


@query(
    "AGG19_panel_metrics",
    f"""SELECT n, np AS n_pathogenic, nb AS n_benign, nl AS n_lof_pathogenic, round(agree / n, 4) AS concordance, round(dec / n, 4) AS decisiveness,
        round(agree / dec, 4) AS concordance_when_decisive, round(pp / cp, 4) AS pathogenic_precision, round(bb / cb, 4) AS benign_precision,
        round(pp / np, 4) AS pathogenic_sensitivity, round(lp / nl, 4) AS lof_pathogenic_sensitivity, round(bb / nb, 4) AS benign_agreement,
        round((nb - bp) / nb, 4) AS benign_specificity, gross AS gross_discordances, round(gross / n, 4) AS gross_discordance_rate
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE truth = 'PATH') AS np, count(*) FILTER (WHERE truth = 'BEN') AS nb, count(*) FILTER (WHERE truth = 'PATH' AND nullv) AS nl,
          count(*) FILTER (WHERE truth = engine) AS agree, count(*) FILTER (WHERE engine <> 'VUS') AS dec, count(*) FILTER (WHERE engine = 'PATH') AS cp, count(*) FILTER (WHERE engine = 'BEN') AS cb,
          count(*) FILTER (WHERE truth = 'PATH' AND engine = 'PATH') AS pp, count(*) FILTER (WHERE truth = 'BEN' AND engine = 'BEN') AS bb,
          count(*) FILTER (WHERE truth = 'PATH' AND nullv AND engine = 'PATH') AS lp, count(*) FILTER (WHERE truth = 'BEN' AND engine = 'PATH') AS bp,
          count(*) FILTER (WHERE (truth = 'PATH' AND engine = 'BEN') OR (truth = 'BEN' AND engine = 'PATH')) AS gross FROM {_PANEL} z) y""",
)
def _(spark, d):
    return evl.panel_metrics(_panel_rows(inputs(spark, d)))


_OUTCOMES = """(SELECT k.sample_id, k.gene, coalesce(o.outcome, 'absent') AS outcome, o.tier FROM answer_key k LEFT JOIN (
  SELECT sample_id, gene, CASE min(CASE WHEN bucket = 'primary' THEN 1 WHEN bucket = 'secondary' THEN 2 WHEN carrier THEN 3 WHEN probable_vus THEN 4 ELSE 5 END)
      WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'carrier' WHEN 4 THEN 'probable_vus' ELSE 'other' END AS outcome,
    arg_min(tier, tier_no * 1000000 + candidate_rank) AS tier FROM tier_order GROUP BY sample_id, gene) o ON o.sample_id = k.sample_id AND o.gene = k.gene)"""


@query("J13_RT10_planted_outcomes", f"SELECT * FROM {_OUTCOMES} z")
def _(spark, d):
    i = inputs(spark, d)
    return evl.planted_outcomes(i.relation("answer_key"), i.routed())


@query("AGG20_outcome_breakdown", f"SELECT outcome, count(*) AS n_cases FROM {_OUTCOMES} z GROUP BY outcome")
def _(spark, d):
    i = inputs(spark, d)
    return evl.outcome_breakdown(evl.planted_outcomes(i.relation("answer_key"), i.routed()))


@query(
    "W5_planted_rank",
    "SELECT k.sample_id, k.gene, min(r.candidate_rank) AS best_rank FROM answer_key k LEFT JOIN ranked r ON r.sample_id = k.sample_id AND r.gene = k.gene GROUP BY k.sample_id, k.gene",
)
def _(spark, d):
    i = inputs(spark, d)
    ranked = ranked_candidates(i.found, i.patient_terms, i.knowledge, carried=("gene",))
    return evl.planted_ranks(i.relation("answer_key"), ranked).drop("n_calls")


_SIGNALS = f"""(SELECT k.sample_id, k.gene, coalesce(s.e, false) AS engine_plp, coalesce(s.p, false) AS pheno_primary, coalesce(s.f, false) AS clinvar_flag, coalesce(n.n, 0) AS n_plp
  FROM answer_key k LEFT JOIN (SELECT sample_id, gene, bool_or({PLP_TIER}) AS e, bool_or({PLP_TIER} AND bucket = 'primary') AS p, bool_or(dismissable) AS f FROM routed GROUP BY sample_id, gene) s
    ON s.sample_id = k.sample_id AND s.gene = k.gene LEFT JOIN (SELECT sample_id, count(*) FILTER (WHERE {PLP_TIER}) AS n FROM routed GROUP BY sample_id) n ON n.sample_id = k.sample_id)"""


@query(
    "RT9_case_signals",
    f"SELECT *, engine_plp OR pheno_primary AS engine_only, engine_plp OR pheno_primary OR clinvar_flag AS surfaced FROM {_SIGNALS} z",
)
def _(spark, d):
    i = inputs(spark, d)
    return evl.case_signals(i.relation("answer_key"), i.routed())


_DECOY_SIGNALS = _SIGNALS.replace("FROM routed", "FROM decoy_routed")


@query(
    "AGG21_adversarial_summary",
    f"""SELECT count(*) AS n_cases, count(*) FILTER (WHERE surfaced) AS n_surfaced, count(*) FILTER (WHERE eo) AS n_engine_only, count(*) FILTER (WHERE engine_plp) AS n_engine_plp,
        count(*) FILTER (WHERE pheno_primary) AS n_pheno_primary, count(*) FILTER (WHERE decoy) AS n_decoy_pheno_primary, count(*) FILTER (WHERE decoy_up) AS n_decoy_surfaced,
        100 * count(*) FILTER (WHERE surfaced) // count(*) AS pct_surfaced, 100 * count(*) FILTER (WHERE eo) // count(*) AS pct_engine_only, 100 * count(*) FILTER (WHERE engine_plp) // count(*) AS pct_engine_plp,
        100 * count(*) FILTER (WHERE pheno_primary) // count(*) AS pct_pheno_primary, 100 * count(*) FILTER (WHERE decoy) // count(*) AS pct_decoy_pheno_primary,
        100 * count(*) FILTER (WHERE decoy_up) // count(*) AS pct_decoy_surfaced,
        count(*) FILTER (WHERE clinvar_flag AND NOT eo) AS n_only_clinvar_flag, max(n_plp) AS over_call_max, min(n_plp) AS over_call_min,
        list_sort(list(n_plp))[1 + count(*) // 2] AS over_call_median
        FROM (SELECT z.*, z.engine_plp OR z.pheno_primary AS eo, z.engine_plp OR z.pheno_primary OR z.clinvar_flag AS surfaced,
            l.pheno_primary AS decoy, l.engine_plp OR l.pheno_primary OR l.clinvar_flag AS decoy_up
          FROM {_SIGNALS} z JOIN {_DECOY_SIGNALS} l ON l.sample_id = z.sample_id) y""",
)
def _(spark, d):
    i = inputs(spark, d)
    lent = evl.decoy_pairs(i.relation("cases"), ["case_no"])
    key = i.keep("answer_key", lambda: i.relation("answer_key"))
    own, decoy = with_lent_phenotypes(i.found, i.patient_terms, lent, i.knowledge, asked=key, columns=rt.ROUTED_ON)
    return evl.adversarial_summary(stored(evl.with_decoy_signals(key, own, decoy)))


@query("J14_decoy_pairs", DECOYS)
def _(spark, d):
    return evl.decoy_pairs(inputs(spark, d).relation("cases"), ["case_no"]).select("sample_id", "decoy_sample_id")


@query(
    "J15_unused_cases",
    """SELECT case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM answer_key k WHERE k.gene = c.gene)
       AND NOT EXISTS (SELECT 1 FROM freq_store u WHERE u.chrom = c.chrom AND u.pos = c.pos AND u.ref = c.ref AND u.alt = c.alt AND u.filter <> 'PASS')""",
)
def _(spark, d):
    i = inputs(spark, d)
    used = i.relation("freq_store").where(c("filter") != "PASS").withColumn("gene", F.lit("none"))
    taken = i.relation("answer_key").select("gene", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("int").alias("pos"),
                                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("alt"))
    return evl.unused_cases(i.relation("cases"), taken.unionByName(used.select("gene", "chrom", "pos", "ref", "alt"))).select("case_id")


@query(
    "J16_labelled_lookup",
    "SELECT p.key, nullif(a.significance, '') AS clinvar_significance FROM panel p LEFT JOIN assertion_store a ON replace(a.chrom, 'chr', '') || '-' || a.pos || '-' || a.ref || '-' || a.alt = p.key",
)
def _(spark, d):
    from locusflow.operators.evidence import LocusJoins, join_assertions

    i = inputs(spark, d)
    parts = F.split("key", "-")
    labelled = i.relation("panel").select("key", parts[0].alias("chrom"), parts[1].cast("int").alias("pos"), parts[2].alias("ref"), parts[3].alias("alt"))
    joined = join_assertions(LocusJoins(labelled, spread_on=["key"]), i.relation("assertion_store")).done()
    return joined.select("key", "clinvar_significance")


@query(
    "J18_genotype_plan",
    """SELECT c.case_id, CASE WHEN c.z = 'hom' THEN 'hom' WHEN o.pos IS NOT NULL THEN 'compound_het' ELSE 'single_het' END AS mode,
         CASE WHEN coalesce(c.z, '') <> 'hom' THEN o.pos END AS second_pos
       FROM (SELECT sample_id AS case_id, arg_min(zygosity, line_no) FILTER (WHERE zygosity IS NOT NULL) AS z0, min(line_no) AS first_line FROM calls GROUP BY sample_id) f
       JOIN (SELECT sample_id AS case_id, line_no, zygosity AS z FROM calls) c ON c.case_id = f.case_id AND c.line_no = f.first_line
       LEFT JOIN (SELECT sample_id AS case_id, pos, row_number() OVER (PARTITION BY sample_id ORDER BY line_no) AS rn FROM calls) o ON o.case_id = c.case_id AND o.rn = 2""",
)
def _(spark, d):
    i = inputs(spark, d)
    calls = i.calls.withColumn("case_id", c("sample_id"))
    first = calls.groupBy("case_id").agg(F.min("line_no").alias("first_line"))
    alleles = calls.join(first, "case_id").withColumns({"is_primary": c("line_no") == c("first_line"), "allele_no": c("line_no")})
    return evl.plan_modes(alleles).select("case_id", "mode", "second_pos")


@query(
    "AGG26_consequence_distribution", "SELECT consequence, count(*) AS n_cases FROM cases GROUP BY consequence"
)
def _(spark, d):
    return evl.consequence_distribution(inputs(spark, d).relation("cases"))


@query(
    "AGG26_quota_selection",
    """SELECT case_id, by_quota FROM (SELECT *, row_number() OVER (ORDER BY by_quota DESC, case_no, case_id) AS place FROM (
         SELECT *, rn <= CASE consequence WHEN 'missense_variant' THEN 50 WHEN 'inframe_indel' THEN 15 WHEN 'stop_gained' THEN 13 WHEN 'frameshift_variant' THEN 15 WHEN 'start_lost' THEN 7 ELSE 0 END AS by_quota
         FROM (SELECT *, row_number() OVER (PARTITION BY consequence ORDER BY gene, case_id) AS rn FROM cases) a) b) x WHERE place <= 100""",
)
def _(spark, d):
    return evl.quota_selection(inputs(spark, d).relation("cases")).select("case_id", "by_quota")


@query(
    "W6_stride_sample",
    """SELECT sample_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM calls) x
       WHERE i % greatest(1, n // 80) = 0 OR gene = 'GENE9'""",
)
def _(spark, d):
    calls = inputs(spark, d).calls.select("sample_id", "line_no", "gene")
    return evl.stride_sample(calls, ["sample_id"], ["line_no"], 80, c("gene") == "GENE9").select("sample_id", "line_no")


@query(
    "SET6_panel_top_up",
    "SELECT key, 'old' AS origin FROM panel UNION ALL SELECT key, 'new' FROM local_freq WHERE key NOT IN (SELECT key FROM panel)",
)
def _(spark, d):
    i = inputs(spark, d)
    old = i.relation("panel").select("key", F.lit("old").alias("origin"))
    return evl.new_panel_rows(old, i.relation("local_freq").select("key", F.lit("new").alias("origin")))


# --- store health ----------------------------------------------------------------------------
def _status(spark, i):
    measures = store_measures(i.relation("freq_store"), "gnomad").unionByName(store_measures(i.knowledge.missense, "alphamissense"))
    counted = i.relation("freq_store").agg(rows("rows_expected"))
    manifests = counted.select(
        F.explode(
            F.array(
                F.struct(F.lit("gnomad").alias("store"), F.lit(True).alias("present"), F.lit(True).alias("readable"), c("rows_expected"), F.lit("2024-01-01T00:00:00").alias("built_at")),
                F.struct(F.lit("alphamissense").alias("store"), F.lit(True).alias("present"), F.lit(False).alias("readable"), c("rows_expected"), F.lit("2024-01-01T00:00:00").alias("built_at")),
                F.struct(F.lit("clinvar").alias("store"), F.lit(False).alias("present"), F.lit(False).alias("readable"), c("rows_expected"), F.lit(None).cast("string").alias("built_at")),
            )
        ).alias("m")
    ).select("m.*")
    return store_status(measures, manifests, F.lit("2024-01-11T12:00:00").cast("timestamp"))


@query(
    "AGG23_store_status",
    """SELECT 'gnomad' AS store, count(*) AS rows, 10.5 AS age_days, 'incomplete' AS status FROM freq_store
       UNION ALL SELECT 'alphamissense', (SELECT count(*) FROM score_store), 10.5, 'corrupt' UNION ALL SELECT 'clinvar', NULL, NULL, 'missing'""",
)
def _(spark, d):
    return _status(spark, inputs(spark, d)).select("store", "rows", "age_days", "status")


@query("SET4_missing_contigs", """SELECT 'chrX,chrY' AS missing FROM (SELECT count(*) AS n FROM freq_store) x""")
def _(spark, d):
    measured = store_measures(inputs(spark, d).relation("freq_store"), "gnomad")
    return measured.select(F.array_join("missing_contigs", ",").alias("missing"))


@query("AGG24_readiness", "SELECT count(*) < 0 AS ready, 'alphamissense,clinvar,gnomad' AS blocking, '' AS stale FROM freq_store")
def _(spark, d):
    ready = readiness(_status(spark, inputs(spark, d)))
    return ready.select("ready", F.array_join("blocking", ",").alias("blocking"), F.array_join("stale", ",").alias("stale"))


@query(
    "SNK3_coverage_mode",
    "SELECT 'partial' AS mode, count(DISTINCT chrom) AS n_contigs, count(*) AS rows FROM freq_store",
)
def _(spark, d):
    built = inputs(spark, d).relation("freq_store").groupBy("chrom").agg(rows("n_rows"))
    return sb.coverage_mode(built, built.select("chrom"), None, None).select("mode", F.size("contigs").alias("n_contigs"), "rows")


# Three stores committed by version: every contig and current, every contig and old, two contigs short.
_NAMED = "CASE p_partkey % {n} WHEN 22 THEN 'chrX' WHEN 23 THEN 'chrY' ELSE 'chr' || (1 + p_partkey % {n}) END"
_COMMITTED = {"gnomad": (24, "2024-01-01T00:00:00"), "clinvar": (24, "2024-01-01T00:00:00"), "alphamissense": (22, "2024-01-10T00:00:00")}
_HEALTH_NOW = "2024-01-20T12:00:00"


def _committed(i, name: str) -> str:
    """Path of a store written from the part table, in the shared folder."""
    contigs, built_at = _COMMITTED[name]

    def build() -> str:
        k = c("p_partkey")
        number = k % contigs
        chrom = F.when(number == 22, "chrX").when(number == 23, "chrY").otherwise(F.concat(F.lit("chr"), (number + 1).cast("string")))
        store = i.spark.read.parquet(f"{i.sf_dir}/part.parquet").select(
            chrom.alias("chrom"), k.cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"),
            F.lit(0.5).alias("af"), F.lit(0.5).alias("am_pathogenicity"), F.lit("x").alias("am_class"),
            F.lit("Benign").alias("significance"), F.lit("").alias("review_status"), F.lit(1).alias("review_stars"),
        )
        path = shared_path(i.spark, name)
        ls.write_version(store, path, name, built_at=built_at, buckets=8)
        return path

    return i.once(f"store {name}", build)


def _committed_status(spark, i):
    paths = {name: _committed(i, name) for name in _COMMITTED}
    measures = [store_measures(ls.read_version(spark, path), name) for name, path in paths.items()]
    now = F.lit(_HEALTH_NOW).cast("timestamp")
    return store_status(measures[0].unionByName(measures[1]).unionByName(measures[2]), ls.manifest_rows(spark, paths), now)


_COMMITTED_STATUS = "(" + " UNION ALL ".join(
    f"""SELECT '{name}' AS store, count(*) AS rows, {age} AS age_days, CASE WHEN count(DISTINCT {_NAMED.format(n=n)}) < 24 THEN 'incomplete'
      WHEN {age} > 14 AND '{name}' = 'clinvar' THEN 'stale' ELSE 'ok' END AS status FROM part"""
    for name, (n, built), age in ((k, v, 19.5 if v[1].startswith("2024-01-01") else 10.5) for k, v in _COMMITTED.items())
) + ")"


@query("AGG23_committed_stores", f"SELECT * FROM {_COMMITTED_STATUS} z")
def _(spark, d):
    return _committed_status(spark, inputs(spark, d)).select("store", "rows", "age_days", "status")


@query(
    "AGG24_committed_readiness",
    f"""SELECT count(*) FILTER (WHERE status = 'incomplete') = 0 AS ready, coalesce(string_agg(store, ',' ORDER BY store) FILTER (WHERE status = 'incomplete'), '') AS blocking,
        coalesce(string_agg(store, ',' ORDER BY store) FILTER (WHERE status = 'stale'), '') AS stale FROM {_COMMITTED_STATUS} z""",
)
def _(spark, d):
    ready = readiness(_committed_status(spark, inputs(spark, d)))
    return ready.select("ready", F.array_join("blocking", ",").alias("blocking"), F.array_join("stale", ",").alias("stale"))


@query(
    "SNK4_footer_measures",
    f"SELECT {_NAMED.format(n=24)} AS contig, count(*) AS rows, min(p_partkey)::INT AS first_pos, max(p_partkey)::INT AS last_pos FROM part GROUP BY 1",
)
def _(spark, d):
    return ls.version_measures(spark, _committed(inputs(spark, d), "gnomad"))


@query(
    "SNK3_committed_modes",
    f"""SELECT store, mode, n_contigs, rows FROM (SELECT count(DISTINCT {_NAMED.format(n=24)}) AS a, count(DISTINCT {_NAMED.format(n=22)}) AS b, count(*) AS rows FROM part) p,
        LATERAL (SELECT unnest(['gnomad', 'gnomad bed', 'alphamissense']) AS store, unnest([CASE WHEN a = 24 THEN 'full' ELSE 'partial' END, CASE WHEN a = 24 THEN 'bed' ELSE 'partial' END,
          CASE WHEN b = 24 THEN 'full' ELSE 'partial' END]) AS mode, unnest([a, a, b]) AS n_contigs) m""",
)
def _(spark, d):
    i, modes = inputs(spark, d), []
    for label, name, bed in (("gnomad", "gnomad", None), ("gnomad bed", "gnomad", "panel.bed"), ("alphamissense", "alphamissense", None)):
        built = ls.version_measures(spark, _committed(i, name)).select(c("contig").alias("chrom"), c("rows").alias("n_rows"))
        mode = sb.coverage_mode(built, built.select("chrom"), None, bed)
        modes.append(mode.select(F.lit(label).alias("store"), "mode", F.size("contigs").cast("long").alias("n_contigs"), "rows"))
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query(
    "J1_laid_out_store",
    "SELECT g.sample_id, g.line_no, f.af AS store_af, f.pos IS NOT NULL AS matched FROM calls g LEFT JOIN freq_store f ON g.chrom = f.chrom AND g.pos = f.pos AND g.ref = f.ref AND g.alt = f.alt",
)
def _(spark, d):
    i = inputs(spark, d)

    def build() -> str:
        path = shared_path(spark, "frequencies")
        ls.write_version(i.relation("freq_store"), path, "gnomad", buckets=16)
        return path

    contigs = [r["chrom"] for r in i.calls.select("chrom").distinct().collect()]  # names of contigs
    store = ls.read_version(spark, i.once("laid frequencies", build), contigs)
    joined = LocusJoins(i.calls).left(store, {"store_af": c("af"), "matched": F.lit(True)}).done()
    return joined.select("sample_id", "line_no", "store_af", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(
    "SNK2_contigs_to_build",
    "SELECT DISTINCT chrom FROM freq_store WHERE chrom NOT IN ('chr1', 'chr2')",
)
def _(spark, d):
    scope = inputs(spark, d).relation("freq_store").select("chrom").distinct().select(
        "chrom", F.lit(None).cast("string").alias("region"), F.lit("panel.bed").alias("bed"), F.lit("joint").alias("preset")
    )
    built = scope.withColumn("bed", F.when(c("chrom").isin("chr1", "chr2"), "panel.bed"))
    return sb.contigs_to_build(scope, built).select("chrom")

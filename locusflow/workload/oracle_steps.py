"""The same analysis as plain SQL steps for DuckDB, used only to check results."""

from __future__ import annotations

import re

from locusflow.workload.relations import needed, oracle_relations

_PLP = "(starts_with(lower({c}), 'pathogenic') OR starts_with(lower({c}), 'likely pathogenic'))"
PLP_SIG = f"coalesce({_PLP.format(c='clinvar_significance')}, false)"
BLB_SIG = (
    "coalesce(starts_with(lower(clinvar_significance), 'benign') "
    "OR starts_with(lower(clinvar_significance), 'likely benign'), false)"
)
_REVIEW = "trim(lower(replace(coalesce({c}, ''), '_', ' ')))"
REVIEW = _REVIEW.format(c="clinvar_review_status")
REVIEWED = (
    f"(starts_with({REVIEW}, 'criteria provided') OR {REVIEW} LIKE '%reviewed by expert%' "
    f"OR {REVIEW} LIKE '%practice guideline%')"
)


def stars(column: str) -> str:
    r = _REVIEW.format(c=column)
    return (
        f"CASE WHEN {r} LIKE '%practice guideline%' THEN 4 WHEN {r} LIKE '%reviewed by expert panel%' THEN 3 "
        f"WHEN {r} LIKE '%multiple submitters%' AND {r} LIKE '%no conflict%' THEN 2 "
        f"WHEN {r} LIKE 'criteria provided%' OR {r} LIKE '%single submitter%' OR {r} LIKE '%conflicting%' THEN 1 ELSE 0 END"
    )


FILTER_AF = "greatest(coalesce(gnomad_af, 0), coalesce(abraom_af, 0))"
KEY = "replace(chrom, 'chr', '') || '-' || pos || '-' || ref || '-' || alt"
BENIGN_AF = "coalesce(gnomad_faf95, greatest(gnomad_af, abraom_af))"
PLP_TIER = "tier IN ('Pathogenic', 'Likely Pathogenic')"
BEN_TIER = "tier IN ('Benign', 'Likely Benign')"
RELATED = "coalesce(hpo_match_score, 0) >= 0.6"

_DECIDED = ["PVS1", "PM2", "PM4", "PP3", "PP4", "PP5", "BA1", "BS1", "BS2", "BP4", "BP6", "BP7"]
_BENIGN = [x for x in _DECIDED if x.startswith("B")]
_PATH = [x for x in _DECIDED if not x.startswith("B")]


def _count(codes: list[str], strength: str) -> str:
    return "(" + " + ".join(f"CASE WHEN s_{x} = '{strength}' THEN 1 ELSE 0 END" for x in codes) + ")"


def _points() -> str:
    parts = [
        f"CASE s_{x} WHEN 'very_strong' THEN 8 WHEN 'strong' THEN 4 WHEN 'moderate' THEN 2 WHEN 'supporting' THEN 1 ELSE 0 END"
        for x in _PATH
    ] + [
        f"CASE s_{x} WHEN 'stand_alone' THEN -8 WHEN 'strong' THEN -4 WHEN 'moderate' THEN -2 WHEN 'supporting' THEN -1 ELSE 0 END"
        for x in _BENIGN
    ]
    return "(" + " + ".join(parts) + ")"


MET_TEXT = "concat_ws(' + ', " + ", ".join(f"CASE WHEN s_{x} IS NOT NULL THEN '{x}' END" for x in _DECIDED) + ")"

STEPS = {
    "graded": """
SELECT *, CASE WHEN zygosity IS NULL THEN 'non-carrier' WHEN filter_status NOT IN ('PASS', '.', '') THEN 'FILTER'
  WHEN depth < 10 THEN 'DP' WHEN gq < 20 THEN 'GQ'
  WHEN zygosity = 'het' AND (allele_balance < 0.25 OR allele_balance > 0.75) THEN 'AB' ELSE 'PASS' END AS qc
FROM calls""",
    "score_store": """
SELECT chrom, pos, ref, alt, am_pathogenicity, am_class FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY am_pathogenicity DESC, transcript_no) AS rn
  FROM score_rows) s WHERE rn = 1""",
    "freq_joined": """
SELECT g.*, CASE WHEN f.pos IS NOT NULL THEN CASE WHEN f.filter = 'PASS' THEN 'frequency' ELSE 'filtered' END
    WHEN g.chrom NOT IN ('chr21', 'chr22') THEN 'absent' ELSE 'unknown' END AS state,
  f.af AS raw_af, f.af_grpmax, f.ac AS raw_ac, f.an AS raw_an, f.nhomalt, f.faf95 AS raw_faf95, f.grpmax_pop
FROM graded g LEFT JOIN freq_store f ON g.chrom = f.chrom AND g.pos = f.pos AND g.ref = f.ref AND g.alt = f.alt""",
    "freq_resolved": """
SELECT * EXCLUDE (raw_af, af_grpmax, raw_ac, raw_an, nhomalt, raw_faf95, grpmax_pop),
  CASE state WHEN 'frequency' THEN coalesce(af_grpmax, raw_af) WHEN 'absent' THEN 0 END AS gnomad_af,
  CASE state WHEN 'frequency' THEN raw_ac WHEN 'absent' THEN 0 END AS gnomad_ac,
  CASE state WHEN 'frequency' THEN raw_an WHEN 'absent' THEN 0 END AS gnomad_an,
  CASE state WHEN 'frequency' THEN nhomalt WHEN 'absent' THEN 0 END AS gnomad_homozygotes,
  CASE state WHEN 'frequency' THEN raw_faf95 WHEN 'absent' THEN 0 END AS gnomad_faf95,
  CASE state WHEN 'frequency' THEN grpmax_pop END AS gnomad_popmax_pop
FROM freq_joined""",
    "annotated_all": f"""
SELECT r.*, nullif(a.significance, '') AS clinvar_significance,
  CASE WHEN a.significance <> '' THEN a.review_status END AS clinvar_review_status,
  CASE WHEN a.significance <> '' THEN a.accession END AS clinvar_accession,
  CASE WHEN a.significance <> '' THEN a.condition END AS clinvar_condition,
  l.af AS abraom_af, s.am_pathogenicity, s.am_class, p.revel, p.cadd AS cadd_phred,
  {KEY.replace('chrom', 'r.chrom').replace('pos', 'r.pos').replace('ref', 'r.ref').replace('alt', 'r.alt')} AS vkey
FROM freq_resolved r
LEFT JOIN assertion_store a ON r.chrom = a.chrom AND r.pos = a.pos AND r.ref = a.ref AND r.alt = a.alt
LEFT JOIN score_store s ON r.chrom = s.chrom AND r.pos = s.pos AND r.ref = s.ref AND r.alt = s.alt
LEFT JOIN local_freq l ON l.key = replace(r.chrom, 'chr', '') || '-' || r.pos || '-' || r.ref || '-' || r.alt
LEFT JOIN predictors p ON p.key = replace(r.chrom, 'chr', '') || '-' || r.pos || '-' || r.ref || '-' || r.alt""",
    "flagged": f"""
SELECT *, qc = 'PASS' AS kept,
  {FILTER_AF} <= 0.005 OR {PLP_SIG} AS rare,
  coalesce(consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'splice_acceptor_variant',
    'start_lost', 'stop_lost', 'missense_variant', 'inframe_insertion', 'inframe_deletion')
    OR lower(consequence) LIKE '%inframe%', false) OR {PLP_SIG} AS impact
FROM annotated_all""",
    "found": "SELECT * FROM flagged WHERE kept AND rare AND impact",
    "gene_modes": """
SELECT upper(gene) AS ugene, bool_or(term = 'HP:0000006') AS ad, bool_or(term = 'HP:0000007') AS ar,
  bool_or(term IN ('HP:0001417', 'HP:0001419', 'HP:0001423')) AS xl
FROM gene_terms GROUP BY upper(gene)""",
    "profiled": """
SELECT f.*, CASE WHEN c.gene IS NOT NULL THEN coalesce(c.pli >= 0.9, false) OR coalesce(c.loeuf < 0.35, false) END AS lof_intolerant,
  f.gene IS NOT NULL AND upper(f.gene) IN (SELECT upper(gene) FROM haploinsufficient) AS hi,
  f.gene IN (SELECT gene FROM secondary_genes) AS sf,
  coalesce(m.ad, false) AS ad, coalesce(m.ar, false) AS ar, coalesce(m.xl, false) AS xl
FROM found f LEFT JOIN gene_constraint c ON f.gene = c.gene LEFT JOIN gene_modes m ON upper(f.gene) = m.ugene""",
    "closure": """
SELECT term, term AS ancestor FROM terms
UNION SELECT c.term, i.parent FROM closure c JOIN is_a i ON i.child = c.ancestor""",
    "content": """
SELECT t.term, count(DISTINCT g.gene) AS n_genes,
  round(-ln(greatest(count(DISTINCT g.gene), 1) / (SELECT greatest(count(DISTINCT gene), 1)
    FROM gene_terms WHERE term IN (SELECT term FROM terms))), 4) AS ic
FROM terms t LEFT JOIN closure c ON c.ancestor = t.term LEFT JOIN gene_terms g ON g.term = c.term
GROUP BY t.term""",
    "patient_vocabulary": "SELECT DISTINCT term FROM patient_terms",
    "gene_vocabulary": "SELECT DISTINCT term FROM phenotype_terms",
    "term_pairs": """
SELECT p.term AS pterm, q.term AS gterm, max(i.ic) AS mica
FROM patient_vocabulary p JOIN closure cp ON cp.term = p.term JOIN closure cg ON cg.ancestor = cp.ancestor
JOIN gene_vocabulary q ON q.term = cg.term JOIN content i ON i.term = cp.ancestor
GROUP BY p.term, q.term""",
    "term_similarity": """
SELECT pterm, gterm, CASE WHEN pterm = gterm THEN 1.0 WHEN a.ic + b.ic <= 0 THEN 0.0
  ELSE greatest(0.0, least(1.0, 2.0 * mica / (a.ic + b.ic))) END AS sim
FROM term_pairs JOIN content a ON a.term = pterm JOIN content b ON b.term = gterm""",
    "best_pairs": """
SELECT gene, pterm, sim, gterm FROM (
  SELECT g.gene, s.pterm, s.sim, s.gterm,
    row_number() OVER (PARTITION BY g.gene, s.pterm ORDER BY s.sim DESC, s.gterm) AS rn
  FROM term_similarity s JOIN phenotype_terms g ON g.term = s.gterm WHERE s.sim > 0) x WHERE rn = 1""",
    "pheno": """
SELECT f.sample_id, f.gene, round(sum(coalesce(b.sim, 0)) / count(*), 3) AS hpo_match_score,
  round(max(coalesce(b.sim, 0)), 3) AS hpo_best_match,
  count(*) FILTER (WHERE b.sim >= 0.3) AS n_matched_terms
FROM (SELECT DISTINCT sample_id, gene FROM found) f JOIN patient_terms p ON p.sample_id = f.sample_id
LEFT JOIN best_pairs b ON b.gene = f.gene AND b.pterm = p.term
GROUP BY f.sample_id, f.gene""",
    "scored": """
SELECT p.*, coalesce(h.hpo_match_score, 0) AS hpo_match_score, coalesce(h.hpo_best_match, 0) AS hpo_best_match
FROM profiled p LEFT JOIN pheno h ON p.sample_id = h.sample_id AND p.gene = h.gene""",
    "strengths": f"""
SELECT *, CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'splice_acceptor_variant', 'start_lost')
    AND (coalesce(lof_intolerant, false) OR hi OR ar) THEN
      CASE WHEN exon IS NULL THEN 'very_strong' WHEN consequence = 'start_lost' THEN 'moderate'
        WHEN consequence IN ('stop_gained', 'frameshift_variant') AND split_part(exon, '/', 1) = split_part(exon, '/', 2) THEN 'strong'
        ELSE 'very_strong' END END AS s_PVS1,
  CASE WHEN gnomad_af <= pm2_ceiling AND coalesce(abraom_af, 0) <= pm2_ceiling THEN 'supporting' END AS s_PM2,
  CASE WHEN consequence LIKE '%inframe%' OR consequence = 'stop_lost' THEN 'moderate' END AS s_PM4,
  CASE WHEN am_pathogenicity IS NOT NULL THEN CASE WHEN am_pathogenicity >= 0.99 THEN 'strong'
      WHEN am_pathogenicity >= 0.9 THEN 'moderate' WHEN am_pathogenicity >= 0.564 THEN 'supporting' END
    WHEN damaging AND NOT tolerated THEN 'supporting' END AS s_PP3,
  CASE WHEN hpo_match_score >= 0.6 THEN 'supporting' END AS s_PP4,
  CASE WHEN {PLP_SIG} AND {REVIEWED} THEN 'supporting' END AS s_PP5,
  CASE WHEN {BENIGN_AF} >= 0.05 THEN 'stand_alone' END AS s_BA1,
  CASE WHEN {BENIGN_AF} >= bs1_cutoff AND {BENIGN_AF} < 0.05 THEN 'strong' END AS s_BS1,
  CASE WHEN gnomad_homozygotes >= 2 THEN 'strong' END AS s_BS2,
  CASE WHEN am_pathogenicity IS NOT NULL THEN CASE WHEN am_pathogenicity <= 0.34 THEN 'supporting' END
    WHEN tolerated AND NOT damaging THEN 'supporting' END AS s_BP4,
  CASE WHEN {BLB_SIG} AND {REVIEWED} THEN 'supporting' END AS s_BP6,
  CASE WHEN consequence = 'synonymous_variant' THEN 'supporting' END AS s_BP7
FROM (SELECT *, CASE WHEN ad OR xl THEN 1e-4 WHEN ar THEN 1e-3 ELSE 1e-4 END AS pm2_ceiling,
    CASE WHEN ar THEN 0.01 WHEN ad OR xl THEN 0.001 ELSE 0.005 END AS bs1_cutoff,
    coalesce(revel >= 0.7, false) OR coalesce(cadd_phred >= 20, false) AS damaging,
    coalesce(revel <= 0.15, false) OR coalesce(cadd_phred <= 10, false) AS tolerated FROM scored) z""",
    "counted": f"""
SELECT *, {_count(_PATH, 'very_strong')} AS pvs, {_count(_PATH, 'strong')} AS ps, {_count(_PATH, 'moderate')} AS pm,
  {_count(_PATH, 'supporting')} AS pp, {_count(_BENIGN, 'stand_alone')} AS ba, {_count(_BENIGN, 'strong')} AS bs,
  {_count(_BENIGN, 'supporting')} AS bp, {_points()} AS points, {MET_TEXT} AS met_text
FROM strengths""",
    "labelled": """
SELECT *,
  CASE WHEN pvs >= 1 AND (ps >= 1 OR pm >= 2 OR (pm = 1 AND pp >= 1) OR pp >= 2) THEN 'PATH-1 (PVS1 + strong/moderate/supporting)'
    WHEN ps >= 2 THEN 'PATH-2 (>=2 Strong)'
    WHEN ps = 1 AND (pm >= 3 OR (pm >= 2 AND pp >= 2) OR (pm = 1 AND pp >= 4)) THEN 'PATH-3 (1 Strong + Moderate/Supporting)' END AS l_path,
  CASE WHEN pvs >= 1 AND pm >= 1 THEN 'LP-1 (PVS1 + Moderate)' WHEN pvs >= 1 AND pp >= 1 THEN 'LP-1 (PVS1 + Supporting)'
    WHEN ps = 1 AND pm IN (1, 2) THEN 'LP-2 (1 Strong + 1-2 Moderate)' WHEN ps = 1 AND pp >= 2 THEN 'LP-3 (1 Strong + >=2 Supporting)'
    WHEN pm >= 3 THEN 'LP-4 (>=3 Moderate)' WHEN pm >= 2 AND pp >= 2 THEN 'LP-5 (2 Moderate + >=2 Supporting)'
    WHEN pm = 1 AND pp >= 4 THEN 'LP-6 (1 Moderate + >=4 Supporting)' END AS l_lp,
  CASE WHEN ba >= 1 THEN 'BEN-1 (BA1 stand-alone)' WHEN bs >= 2 THEN 'BEN-2 (>=2 Strong benign)' END AS l_ben,
  CASE WHEN bs = 1 AND bp >= 1 THEN 'LB-1 (1 Strong + 1 Supporting benign)' WHEN bp >= 2 THEN 'LB-2 (>=2 Supporting benign)' END AS l_lb
FROM counted""",
    "tiered": """
SELECT *, CASE WHEN (l_path IS NOT NULL OR l_lp IS NOT NULL) AND (l_ben IS NOT NULL OR l_lb IS NOT NULL) THEN 'Uncertain Significance (VUS)'
  WHEN l_path IS NOT NULL THEN 'Pathogenic' WHEN l_lp IS NOT NULL THEN 'Likely Pathogenic'
  WHEN l_ben IS NOT NULL THEN 'Benign' WHEN l_lb IS NOT NULL THEN 'Likely Benign' ELSE 'Uncertain Significance (VUS)' END AS tier
FROM labelled""",
    "classified": """
SELECT *, CASE WHEN met_text = '' THEN 'no criteria met' ELSE met_text END || ' => ' ||
  CASE WHEN coalesce(l_path, l_lp) IS NOT NULL AND coalesce(l_ben, l_lb) IS NOT NULL THEN 'conflicting pathogenic & benign evidence => VUS'
    WHEN coalesce(l_path, l_lp, l_ben, l_lb) IS NOT NULL THEN tier || ' [' || coalesce(l_path, l_lp, l_ben, l_lb) || ']'
    ELSE 'criteria insufficient for a benign or pathogenic call => VUS' END AS rule_path
FROM tiered""",
    "hits": f"SELECT sample_id, gene, count(*) AS n_pathogenic FROM classified WHERE {PLP_TIER} GROUP BY sample_id, gene",
    "routed": f"""
SELECT *, CASE WHEN artifact AND NOT ({RELATED} AND {PLP_TIER}) THEN 'other' WHEN carrier THEN 'other'
    WHEN {RELATED} AND NOT {BEN_TIER} THEN 'primary' WHEN NOT {RELATED} AND {PLP_TIER} AND sf THEN 'secondary' ELSE 'other' END AS bucket,
  tier = 'Uncertain Significance (VUS)' AND {RELATED} AND molecular >= 2 AS probable_vus,
  {PLP_SIG} AND {stars('clinvar_review_status')} >= 2 AND NOT {PLP_TIER} AS dismissable
FROM (SELECT c.*, coalesce(c.zygosity = 'hom' AND c.gnomad_af = 0, false) AS artifact,
    {PLP_TIER} AND c.zygosity = 'het' AND ar AND NOT ad AND NOT xl AND coalesce(h.n_pathogenic, 0) < 2 AS carrier,
    CASE WHEN am_pathogenicity >= 0.564 THEN 3 WHEN am_pathogenicity >= 0.34 THEN 1 ELSE 0 END
    + CASE WHEN lower(clinvar_significance) LIKE '%conflict%' THEN 1 WHEN lower(clinvar_significance) LIKE '%pathogenic%' THEN 2 ELSE 0 END
    + CASE WHEN lof_intolerant THEN 1 ELSE 0 END AS molecular
  FROM classified c LEFT JOIN hits h ON c.sample_id = h.sample_id AND c.gene = h.gene) x""",
    "ranked": f"""
SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN {PLP_SIG} THEN 0 ELSE 1 END, hpo_match_score DESC,
  {FILTER_AF}, line_no, alt_index) AS candidate_rank FROM routed""",
    "tier_order": """
SELECT *, CASE tier WHEN 'Pathogenic' THEN 1 WHEN 'Likely Pathogenic' THEN 2 WHEN 'Uncertain Significance (VUS)' THEN 3
  WHEN 'Likely Benign' THEN 4 ELSE 5 END AS tier_no FROM ranked""",
    "merged_regions": """
SELECT chrom, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS opens FROM regions) a) b
GROUP BY chrom, island""",
}

# The steps that depend on the phenotype once more, for cases that borrow the terms of the case 50 places on.
_LENT = ("pheno", "scored", "strengths", "counted", "labelled", "tiered", "classified", "hits", "routed")
_LENT_NAME = re.compile(rf"\b(FROM|JOIN) ({'|'.join(_LENT)}|patient_terms)\b")
DECOYS = """SELECT a.sample_id, b.sample_id AS decoy_sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY case_no) - 1 AS i, count(*) OVER () AS n FROM cases) a
  JOIN (SELECT sample_id, row_number() OVER (ORDER BY case_no) - 1 AS i FROM cases) b ON b.i = (a.i + 50) % a.n"""
STEPS |= {f"decoy_{n}": _LENT_NAME.sub(r"\1 decoy_\2", STEPS[n]) for n in _LENT}
STEPS["decoy_patient_terms"] = f"SELECT d.sample_id, p.term FROM ({DECOYS}) d JOIN patient_terms p ON p.sample_id = d.decoy_sample_id"

# The whole analysis once more from VCF text: what the text does not carry is NULL, a missing depth is the sum
# of the allele depths, and files that declare another build keep no evidence by coordinate.
_TEXT = ("graded", "freq_joined", "freq_resolved", "annotated_all", "flagged", "found", "profiled", *_LENT)
_TEXT_NAME = re.compile(rf"\b(FROM|JOIN) ({'|'.join(_TEXT)}|calls)\b")
_BY_COORDINATE = (
    "gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homozygotes", "gnomad_faf95", "gnomad_popmax_pop", "clinvar_significance", "clinvar_review_status",
    "clinvar_accession", "clinvar_condition", "abraom_af", "revel", "cadd_phred", "am_pathogenicity", "am_class",
)
STEPS |= {f"text_{n}": _TEXT_NAME.sub(r"\1 text_\2", STEPS[n]) for n in _TEXT}
STEPS["text_calls"] = "SELECT * REPLACE (CASE WHEN line_no % 5 = 0 THEN 100 ELSE depth END AS depth, NULL::VARCHAR AS exon) FROM calls"
STEPS["text_annotated_all"] = (
    "SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN CAST(substr(sample_id, 2) AS BIGINT) % 2 = 0 THEN {x} END AS {x}" for x in _BY_COORDINATE)
    + f") FROM ({STEPS['text_annotated_all']}) t"
)


def statement(sql: str) -> str:
    """A complete statement: the SQL with every step and relation it needs."""
    definitions = {**oracle_relations(), **STEPS}
    used = needed(sql, definitions)
    heads = [
        f"{n}(term, ancestor) AS ({definitions[n]})" if n == "closure" else f"{n} AS ({definitions[n]})" for n in used
    ]
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + sql if heads else sql

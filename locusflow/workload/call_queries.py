"""Queries on call-level operators: keys, quality, frequency and evidence joins, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import clinical as cl
from locusflow.functions import keys as K
from locusflow.operators import evidence as ev
from locusflow.operators import intervals as iv
from locusflow.operators import quality as q
from locusflow.operators import selection as sel
from locusflow.operators import store_build as sb
from locusflow.operators.ranking import first_per_key
from locusflow.sources.tables import intolerant
from locusflow.workload.inputs import COVERED, inputs
from locusflow.workload.oracle_steps import BENIGN_AF, FILTER_AF, KEY, PLP_SIG, REVIEWED, stars
from locusflow.workload.registry import query

c = F.col


def rows(name: str):
    return F.count(F.lit(1)).alias(name)


# --- keys and scalar functions ------------------------------------------------
@query("FN1_variant_key", f"SELECT sample_id, line_no, {KEY} AS variant_key FROM calls")
def _(spark, d):
    return inputs(spark, d).calls.select("sample_id", "line_no", K.variant_key().alias("variant_key"))


@query(
    "FN2_contig_naming",
    "SELECT replace(chrom, 'chr', '') AS bare, chrom AS prefixed, count(*) AS n FROM calls GROUP BY chrom",
)
def _(spark, d):
    bare = K.bare_contig(c("chrom"))
    return (
        inputs(spark, d).calls.select(bare.alias("bare"), K.prefixed_contig(bare).alias("prefixed"))
        .groupBy("bare", "prefixed").agg(rows("n"))
    )


@query(
    "FN3_zygosity",
    """SELECT line_no, sample_id, CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'hom' WHEN 2 THEN 'het' WHEN 3 THEN NULL
         WHEN 4 THEN CASE WHEN l_linenumber % 2 = 1 THEN 'hemi' END ELSE 'het' END AS zygosity
       FROM (SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS line_no, 'S' || l_suppkey AS sample_id, l_orderkey, l_linenumber FROM lineitem) x""",
)
def _(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    genotype = F.element_at(
        F.array(*[F.lit(g) for g in ("0/0", "1|1", "0/1", "./1")], F.when(c("l_linenumber") % 2 == 1, "1").otherwise("0"), F.lit("1/2")),
        (c("l_orderkey") % 6 + 1).cast("int"),
    )
    return line.select(
        ((c("l_orderkey") * 8 + c("l_linenumber")) * 1000000 + c("l_partkey")).alias("line_no"),
        F.concat(F.lit("S"), "l_suppkey").alias("sample_id"),
        K.zygosity(genotype, F.lit(1)).alias("zygosity"),
    )


@query(
    "FN8_minimal_allele",
    "SELECT ref, alt, CASE WHEN substr(ref, 1, 1) = alt THEN '-' ELSE alt END AS minimal, count(*) AS n FROM calls GROUP BY ALL",
)
def _(spark, d):
    return (
        inputs(spark, d).calls.withColumn("minimal", K.minimal_allele(c("ref"), c("alt")))
        .groupBy("ref", "alt", "minimal").agg(rows("n"))
    )


@query("FN18_review_stars", f"SELECT accession, {stars('review_status')} AS stars FROM assertion_store")
def _(spark, d):
    return inputs(spark, d).relation("assertion_store").select(
        "accession", cl.review_stars(c("review_status")).alias("stars")
    )


@query(
    "FN19_reviewed_and_FN20_asserted",
    f"""SELECT accession, {REVIEWED} AS reviewed, {PLP_SIG} AS pathogenic,
        coalesce(starts_with(lower(clinvar_significance), 'benign') OR starts_with(lower(clinvar_significance), 'likely benign'), false) AS benign
        FROM (SELECT accession, significance AS clinvar_significance, review_status AS clinvar_review_status FROM assertion_store) a""",
)
def _(spark, d):
    sig = c("significance")
    return inputs(spark, d).relation("assertion_store").select(
        "accession",
        cl.is_reviewed(c("review_status")).alias("reviewed"),
        cl.asserts_pathogenic(sig).alias("pathogenic"),
        cl.asserts_benign(sig).alias("benign"),
    )


@query(
    "FN21_truth_class",
    """SELECT accession, CASE WHEN significance = '' THEN NULL WHEN significance IN ('Pathogenic', 'Likely pathogenic') THEN 'PATH'
       WHEN significance IN ('Benign', 'Likely benign') THEN 'BEN' ELSE 'VUS' END AS truth FROM assertion_store""",
)
def _(spark, d):
    return inputs(spark, d).relation("assertion_store").select("accession", cl.truth_class(c("significance")).alias("truth"))


@query(
    "FN22_impact",
    """SELECT consequence, lower(consequence) LIKE '%inframe%' AS inframe, consequence NOT IN ('synonymous_variant', 'intron_variant') AS impactful,
       consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'start_lost') AS null_variant, count(*) AS n
       FROM calls GROUP BY consequence""",
)
def _(spark, d):
    x = c("consequence")
    return (
        inputs(spark, d).calls.groupBy("consequence").agg(rows("n"))
        .select("consequence", cl.is_inframe(x).alias("inframe"), cl.is_impactful(x).alias("impactful"),
                cl.is_null_variant(x).alias("null_variant"), "n")
    )


@query(
    "FN23_last_exon",
    "SELECT exon, coalesce(exon = '5/5', false) AS last_exon, count(*) AS n FROM calls GROUP BY exon",
)
def _(spark, d):
    return (
        inputs(spark, d).calls.groupBy("exon").agg(rows("n"))
        .select("exon", cl.is_last_exon(c("exon")).alias("last_exon"), "n")
    )


@query(
    "FN24_missense_strength",
    """SELECT am_pathogenicity, CASE WHEN am_pathogenicity >= 0.99 THEN 'strong' WHEN am_pathogenicity >= 0.9 THEN 'moderate'
         WHEN am_pathogenicity >= 0.564 THEN 'supporting' END AS pathogenic, CASE WHEN am_pathogenicity <= 0.34 THEN 'supporting' END AS benign,
       count(*) AS n FROM score_rows GROUP BY am_pathogenicity""",
)
def _(spark, d):
    x = c("am_pathogenicity")
    return (
        inputs(spark, d).relation("score_rows").groupBy("am_pathogenicity").agg(rows("n"))
        .select("am_pathogenicity", cl.missense_pathogenic_strength(x).alias("pathogenic"), cl.missense_benign_strength(x).alias("benign"), "n")
    )


@query(
    "FN25_inheritance_thresholds",
    """SELECT lower(ugene) AS gene, CASE WHEN ad OR xl THEN 0.0001 WHEN ar THEN 0.001 ELSE 0.0001 END::DOUBLE AS pm2_ceiling,
         CASE WHEN ad THEN 'AD' WHEN xl THEN 'XL' WHEN ar THEN 'AR' END AS pm2_mode,
         CASE WHEN ar THEN 0.01 WHEN ad OR xl THEN 0.001 ELSE 0.005 END::DOUBLE AS bs1_cutoff,
         CASE WHEN ar THEN 'AR' WHEN ad THEN 'AD' WHEN xl THEN 'XL' END AS bs1_mode
       FROM gene_modes WHERE ad OR ar OR xl""",
)
def _(spark, d):
    from locusflow.operators.phenotype import inheritance_modes

    modes = inheritance_modes(inputs(spark, d).relation("gene_terms"))
    pm2, bs1 = cl.pm2_ceiling(c("modes")), cl.bs1_cutoff(c("modes"))
    return modes.select(
        F.lower("gene").alias("gene"), pm2["ceiling"].alias("pm2_ceiling"), pm2["mode"].alias("pm2_mode"),
        bs1["cutoff"].alias("bs1_cutoff"), bs1["mode"].alias("bs1_mode"),
    )


@query(
    "FN26_benign_frequency",
    f"""SELECT sample_id, line_no, round({BENIGN_AF}, 9) AS benign_af,
        CASE WHEN gnomad_faf95 IS NOT NULL THEN 'faf95' WHEN gnomad_af IS NOT NULL OR abraom_af IS NOT NULL THEN 'popmax' ELSE 'unavailable' END AS basis
        FROM found""",
)
def _(spark, d):
    of = (c("gnomad_faf95"), c("gnomad_af"), c("abraom_af"))
    return inputs(spark, d).found.select(
        "sample_id", "line_no", F.round(cl.benign_frequency(*of), 9).alias("benign_af"), cl.benign_frequency_basis(*of).alias("basis")
    )


@query(
    "FN27_predictor_direction",
    """SELECT key, CASE WHEN p AND b THEN 'conflicting' WHEN p THEN 'pathogenic' WHEN b THEN 'benign' END AS direction
       FROM (SELECT key, coalesce(revel >= 0.7, false) OR coalesce(cadd >= 20, false) AS p,
             coalesce(revel <= 0.15, false) OR coalesce(cadd <= 10, false) AS b FROM predictors) x""",
)
def _(spark, d):
    return inputs(spark, d).relation("predictors").select(
        "key", cl.predictor_direction(c("revel"), c("cadd")).alias("direction")
    )


@query(
    "FN28_consequence_from_protein",
    """SELECT sample_id, line_no, CASE WHEN consequence = 'frameshift_variant' THEN 'frameshift_variant' WHEN consequence = 'stop_gained' THEN 'stop_gained'
         WHEN consequence = 'start_lost' THEN 'start_lost'
         WHEN consequence = 'inframe_deletion' THEN CASE WHEN (length(ref) - length(alt)) % 3 = 0 AND length(ref) <> length(alt) THEN 'inframe_indel' ELSE 'frameshift_variant' END
         ELSE 'missense_variant' END AS consequence FROM calls""",
)
def _(spark, d):
    from locusflow.functions.consequences import consequence_from_protein

    text = (
        F.when(c("consequence") == "frameshift_variant", "p.Ala5fs").when(c("consequence") == "stop_gained", "p.(Trp26Ter)")
        .when(c("consequence") == "start_lost", "p.Met1?").when(c("consequence") == "inframe_deletion", "p.Lys7del")
        .otherwise(c("hgvs_p"))
    )
    return inputs(spark, d).calls.select(
        "sample_id", "line_no", consequence_from_protein(text, c("ref"), c("alt")).alias("consequence")
    )


# --- quality ------------------------------------------------------------------
@query("FLT1_quality_gate", "SELECT sample_id, line_no, qc AS reason FROM graded")
def _(spark, d):
    return inputs(spark, d).calls.select("sample_id", "line_no", q.quality_class().alias("reason"))


@query(
    "AGG7_drop_reasons",
    "SELECT sample_id, qc AS reason, count(*) AS n_calls FROM graded WHERE qc <> 'PASS' GROUP BY sample_id, qc",
)
def _(spark, d):
    return q.drop_histogram(inputs(spark, d).calls)


_PCT = "round(100.0 * {a} / nullif({b}, 0), 1)"
_SNV = "length(ref) = 1 AND length(alt) = 1 AND ref <> alt"
_TI = "ref || alt IN ('AG', 'GA', 'CT', 'TC')"


@query(
    "AGG1_sequencing_quality",
    f"""SELECT b.*, s.n_sites, s.n_multiallelic_sites, round(100.0 * s.n_multiallelic_sites / s.n_sites, 1) AS pct_multiallelic FROM (
        SELECT sample_id, n AS n_variants,
          CASE WHEN n >= 500000 THEN 'whole-genome-scale' WHEN n >= 8000 THEN 'exome / large-panel-scale' WHEN n >= 200 THEN 'targeted-panel-scale' ELSE 'small / demo VCF' END AS assay_guess,
          n AS n_with_dp, round(dp_avg, 1) AS dp_mean, round(dp_med, 1) AS dp_median, round(100.0 * dp10 / n, 1) AS dp_pct_ge10, round(100.0 * dp20 / n, 1) AS dp_pct_ge20,
          n AS n_with_gq, round(gq_med, 1) AS gq_median, round(100.0 * gq20 / n, 1) AS gq_pct_ge20,
          ti + tv AS n_snv, round(ti::DOUBLE / nullif(tv, 0), 2) AS titv, n_het, n_hom, round(n_het::DOUBLE / nullif(n_hom, 0), 2) AS het_hom_ratio,
          n_indel, round(n_indel::DOUBLE / nullif(ti + tv, 0), 3) AS indel_snv_ratio, n_with_rsid,
          CASE WHEN n_with_rsid >= 0.2 * n THEN round(100.0 * (n - n_with_rsid) / n, 1) END AS pct_novel,
          n_het AS n_het_ab, round(100.0 * balanced / nullif(n_het, 0), 1) AS pct_het_ab_balanced, round(100.0 * n_pass / n, 1) AS pct_pass
        FROM (SELECT sample_id, count(*) AS n, avg(depth) AS dp_avg, median(depth) AS dp_med, count(*) FILTER (WHERE depth >= 10) AS dp10,
            count(*) FILTER (WHERE depth >= 20) AS dp20, median(gq) AS gq_med, count(*) FILTER (WHERE gq >= 20) AS gq20,
            count(*) FILTER (WHERE {_SNV} AND {_TI}) AS ti, count(*) FILTER (WHERE {_SNV} AND NOT {_TI}) AS tv,
            count(*) FILTER (WHERE zygosity = 'het') AS n_het, count(*) FILTER (WHERE zygosity = 'hom') AS n_hom,
            count(*) FILTER (WHERE length(ref) <> length(alt)) AS n_indel, count(variant_id) AS n_with_rsid,
            count(*) FILTER (WHERE zygosity = 'het' AND allele_balance BETWEEN 0.25 AND 0.75) AS balanced,
            count(*) FILTER (WHERE filter_status = 'PASS') AS n_pass FROM calls GROUP BY sample_id) a) b
        JOIN (SELECT sample_id, count(*) AS n_sites, count(*) FILTER (WHERE m > 1) AS n_multiallelic_sites
              FROM (SELECT sample_id, chrom, pos, max(n_alts) AS m FROM calls GROUP BY sample_id, chrom, pos) y GROUP BY sample_id) s USING (sample_id)""",
)
def _(spark, d):
    return q.sequencing_quality(inputs(spark, d).calls)


@query(
    "AGG2_assay_class",
    """SELECT sample_id, count(*) AS n, CASE WHEN count(*) >= 500000 THEN 'whole-genome-scale' WHEN count(*) >= 8000 THEN 'exome / large-panel-scale'
       WHEN count(*) >= 200 THEN 'targeted-panel-scale' ELSE 'small / demo VCF' END AS assay FROM calls GROUP BY sample_id""",
)
def _(spark, d):
    counted = inputs(spark, d).calls.groupBy("sample_id").agg(rows("n"))
    return counted.withColumn("assay", q.assay_class(c("n")))


@query(
    "AGG3_transitions",
    f"""SELECT sample_id, count(*) FILTER (WHERE {_SNV} AND {_TI}) AS n_transitions, count(*) FILTER (WHERE {_SNV} AND NOT {_TI}) AS n_transversions,
        round(count(*) FILTER (WHERE {_SNV} AND {_TI}) / nullif(count(*) FILTER (WHERE {_SNV} AND NOT {_TI}), 0), 2) AS titv FROM calls GROUP BY sample_id""",
)
def _(spark, d):
    return q.substitution_counts(inputs(spark, d).calls)


@query(
    "AGG4_sites",
    """SELECT sample_id, count(*) AS n_sites, count(*) FILTER (WHERE m > 1) AS n_multiallelic_sites,
       round(100.0 * count(*) FILTER (WHERE m > 1) / count(*), 1) AS pct_multiallelic
       FROM (SELECT sample_id, chrom, pos, max(n_alts) AS m FROM calls GROUP BY sample_id, chrom, pos) y GROUP BY sample_id""",
)
def _(spark, d):
    return q.site_summary(inputs(spark, d).calls)


@query(
    "AGG5_quality_notes",
    f"""SELECT sample_id, note, value FROM (
          SELECT sample_id, 'depth_at_called_sites_only' AS note, NULL::DOUBLE AS value FROM m
          UNION ALL SELECT sample_id, 'titv', titv FROM m WHERE titv IS NOT NULL
          UNION ALL SELECT sample_id, 'low_median_depth', med FROM m WHERE med < 20
          UNION ALL SELECT sample_id, 'no_rsids_novelty_not_computed', NULL FROM m WHERE rs < 0.2 * n) z""".replace(
        " FROM m",
        f""" FROM (SELECT sample_id, count(*) AS n, count(variant_id) AS rs, round(median(depth), 1) AS med,
           round(count(*) FILTER (WHERE {_SNV} AND {_TI}) / nullif(count(*) FILTER (WHERE {_SNV} AND NOT {_TI}), 0), 2) AS titv
           FROM calls GROUP BY sample_id) m""",
    ),
)
def _(spark, d):
    return q.quality_notes(q.sequencing_quality(inputs(spark, d).calls))


# --- evidence joins -------------------------------------------------------------
_FREQ = ["gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homozygotes", "gnomad_faf95", "gnomad_popmax_pop"]


@query(
    "J1_frequency_join",
    """SELECT sample_id, line_no, state IN ('frequency', 'filtered') AS matched,
       CASE WHEN state IN ('frequency', 'filtered') THEN round(coalesce(af_grpmax, raw_af), 9) END AS af FROM freq_joined WHERE qc = 'PASS'""",
)
def _(spark, d):
    i = inputs(spark, d)
    joined = ev.join_frequency(ev.LocusJoins(q.passing_calls(i.calls)), i.relation("freq_store")).done()
    return joined.select(
        "sample_id", "line_no", F.coalesce("store_matched", F.lit(False)).alias("matched"), F.round("store_af", 9).alias("af")
    )


@query(
    "J2_frequency_states",
    """SELECT sample_id, line_no, state AS frequency_state, round(gnomad_af, 9) AS gnomad_af, gnomad_ac::BIGINT AS gnomad_ac, gnomad_an::BIGINT AS gnomad_an,
       gnomad_homozygotes::BIGINT AS gnomad_homozygotes, round(gnomad_faf95, 9) AS gnomad_faf95, gnomad_popmax_pop FROM freq_resolved WHERE qc = 'PASS'""",
)
def _(spark, d):
    i = inputs(spark, d)
    resolved = ev.with_frequency(q.passing_calls(i.calls), i.relation("freq_store"), i.coverage)
    return resolved.select(
        "sample_id", "line_no", "frequency_state",
        *[F.round(x, 9).alias(x) if x in ("gnomad_af", "gnomad_faf95") else c(x) for x in _FREQ],
    )


@query(
    "J2_panel_coverage",
    """SELECT sample_id, line_no, CASE WHEN matched THEN CASE WHEN passed THEN 'frequency' ELSE 'filtered' END
         WHEN covered AND inside THEN 'absent' ELSE 'unknown' END AS frequency_state
       FROM (SELECT j.sample_id, j.line_no, state IN ('frequency', 'filtered') AS matched, state = 'frequency' AS passed,
           j.chrom NOT IN ('chr21', 'chr22') AS covered, EXISTS (SELECT 1 FROM merged_regions m WHERE m.chrom = j.chrom AND j.pos - 1 >= m.start AND j.pos - 1 < m."end") AS inside
         FROM freq_joined j WHERE qc = 'PASS') x""",
)
def _(spark, d):
    i = inputs(spark, d)
    merged = iv.merge_intervals(i.relation("regions"))
    coverage = ev.Coverage("bed", COVERED, merged)
    resolved = ev.with_frequency(q.passing_calls(i.calls), i.relation("freq_store"), coverage)
    return resolved.select("sample_id", "line_no", "frequency_state")


@query(
    "J3_assertion_join",
    "SELECT sample_id, line_no, clinvar_significance, clinvar_review_status, clinvar_accession, clinvar_condition FROM annotated_all WHERE qc = 'PASS'",
)
def _(spark, d):
    i = inputs(spark, d)
    joined = ev.join_assertions(ev.LocusJoins(q.passing_calls(i.calls)), i.relation("assertion_store")).done()
    return joined.select("sample_id", "line_no", "clinvar_significance", "clinvar_review_status", "clinvar_accession", "clinvar_condition")


@query("J4_missense_join", "SELECT sample_id, line_no, am_pathogenicity, am_class FROM found")
def _(spark, d):
    return inputs(spark, d).found.select("sample_id", "line_no", "am_pathogenicity", "am_class")


@query("J5_local_frequency_join", "SELECT sample_id, line_no, abraom_af FROM annotated_all WHERE qc = 'PASS'")
def _(spark, d):
    i = inputs(spark, d)
    joined = ev.join_local_frequency(ev.LocusJoins(q.passing_calls(i.calls)), i.relation("local_freq")).done()
    return joined.select("sample_id", "line_no", "abraom_af")


@query("J6_predictor_join", "SELECT sample_id, line_no, revel, cadd_phred FROM annotated_all WHERE qc = 'PASS'")
def _(spark, d):
    i = inputs(spark, d)
    joined = ev.join_predictors(ev.LocusJoins(q.passing_calls(i.calls)), i.relation("predictors")).done()
    return joined.select("sample_id", "line_no", "revel", "cadd_phred")


def _profile(i):
    from locusflow.operators.phenotype import inheritance_modes

    k = i.knowledge
    return ev.gene_profile(i.calls, k.constraint, k.haploinsufficient, inheritance_modes(k.gene_terms), k.secondary_genes)


@query(
    "J7_gene_constraint_join",
    """SELECT DISTINCT c.gene, CASE WHEN k.gene IS NOT NULL THEN coalesce(k.pli >= 0.9, false) OR coalesce(k.loeuf < 0.35, false) END AS lof_intolerant
       FROM calls c LEFT JOIN gene_constraint k ON c.gene = k.gene""",
)
def _(spark, d):
    return _profile(inputs(spark, d)).select("gene", "lof_intolerant")


@query(
    "J8_gene_membership",
    """SELECT DISTINCT gene, upper(gene) IN (SELECT upper(gene) FROM haploinsufficient) AS haploinsufficient,
       gene IN (SELECT gene FROM secondary_genes) AS secondary_gene FROM calls""",
)
def _(spark, d):
    return _profile(inputs(spark, d)).select("gene", "haploinsufficient", "secondary_gene")


@query(
    "J11_gene_inheritance",
    """SELECT DISTINCT c.gene, concat_ws('+', CASE WHEN m.ad THEN 'AD' END, CASE WHEN m.ar THEN 'AR' END, CASE WHEN m.xl THEN 'XL' END) AS modes,
       coalesce(m.ar, false) AS recessive_mechanism FROM calls c LEFT JOIN gene_modes m ON upper(c.gene) = m.ugene""",
)
def _(spark, d):
    return _profile(inputs(spark, d)).select("gene", F.array_join("modes", "+").alias("modes"), "recessive_mechanism")


@query(
    "J9_carried_evidence_precedence",
    """SELECT sample_id, line_no, round(CASE g WHEN 0 THEN NULL WHEN 1 THEN 0.25 WHEN 2 THEN gnomad_af ELSE gnomad_af END, 9) AS gnomad_af,
         CASE g WHEN 2 THEN 'Likely benign' ELSE clinvar_significance END AS clinvar_significance,
         CASE WHEN g <= 1 THEN 'info' WHEN gnomad_af IS NOT NULL THEN 'store' ELSE 'none' END AS frequency_from
       FROM (SELECT *, (line_no // 8000000) % 4 AS g FROM annotated_all WHERE qc = 'PASS') x""",
)
def _(spark, d):
    i = inputs(spark, d)
    joins = ev.LocusJoins(q.passing_calls(i.calls))
    ev.join_frequency(joins, i.relation("freq_store"))
    ev.join_assertions(joins, i.relation("assertion_store"))
    stored = ev.resolve_frequency(joins.frame, i.coverage)
    # INFO of each call: unusable value for its allele, usable value, assertion only, bare dot.
    kind = F.floor(c("line_no") / 8000000) % 4
    info = (
        F.when(kind == 0, F.create_map(F.lit("gnomad_AF"), F.lit(".,0.5")))
        .when(kind == 1, F.create_map(F.lit("gnomAD_AF"), F.lit("0.25")))
        .when(kind == 2, F.create_map(F.lit("CLNSIG"), F.lit("Likely_benign")))
        .otherwise(F.create_map(F.lit("gnomad_AF"), F.lit(".")))
    )
    chosen = ev.prefer_carried(stored.withColumn("info", info).withColumn("alt_index", F.lit(0)))
    return chosen.select(
        "sample_id", "line_no", F.round("gnomad_af", 9).alias("gnomad_af"), "clinvar_significance",
        F.element_at("evidence_source", "gnomad").alias("frequency_from"),
    )


# --- selection -------------------------------------------------------------------
def _annotated(i, kept_only=True):
    from locusflow.plans.interpretation import annotate

    calls = q.passing_calls(i.calls) if kept_only else i.calls
    return annotate(calls, i.knowledge).done()


@query("FLT2_rarity", "SELECT sample_id, line_no FROM flagged WHERE kept AND rare")
def _(spark, d):
    return _annotated(inputs(spark, d)).where(sel.is_rare()).select("sample_id", "line_no")


@query("FLT3_impact", "SELECT sample_id, line_no FROM flagged WHERE kept AND impact")
def _(spark, d):
    return _annotated(inputs(spark, d)).where(sel.has_impact()).select("sample_id", "line_no")


@query(
    "FLT4_local_frequency_rescue",
    f"""SELECT sample_id, line_no, gene || ' (' || hgvs_p || '): gnomAD AF=' || printf('%.6f', coalesce(gnomad_af, 0)) || ' but ABraOM AF=' || printf('%.4f', abraom_af) AS note
        FROM flagged WHERE kept AND coalesce(gnomad_af, 0) <= 0.005 AND coalesce(abraom_af, 0) > 0.005 AND NOT {PLP_SIG}""",
)
def _(spark, d):
    annotated = _annotated(inputs(spark, d)).withColumn("variant_key", K.variant_key())
    return sel.rescued_by_local_frequency(annotated).select("sample_id", "line_no", "note")


@query(
    "FLT5_build_trust",
    """SELECT sample_id, line_no, CASE WHEN b = 'GRCh37' THEN NULL ELSE round(gnomad_af, 9) END AS gnomad_af,
         CASE WHEN b IS NULL THEN 'undeclared' WHEN b = 'GRCh37' THEN 'mismatch' END AS build_warning
       FROM (SELECT *, CASE CAST(substr(sample_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'GRCh37' WHEN 1 THEN 'GRCh38' END AS b FROM annotated_all WHERE qc = 'PASS') x""",
)
def _(spark, d):
    number = F.substr("sample_id", F.lit(2)).cast("bigint") % 3
    build = F.when(number == 0, "GRCh37").when(number == 1, "GRCh38")
    trusted = ev.trust_build(_annotated(inputs(spark, d)).withColumn("build", build))
    return trusted.select("sample_id", "line_no", F.round("gnomad_af", 9).alias("gnomad_af"), "build_warning")


@query(
    "FLT7_unresolved_store",
    """SELECT sample_id, count(*) AS n_kept, count(*) FILTER (WHERE state <> 'unknown') AS n_resolved,
       count(*) >= 50 AND count(*) FILTER (WHERE state <> 'unknown') = 0 AS over_call_warning FROM freq_joined WHERE qc = 'PASS' GROUP BY sample_id""",
)
def _(spark, d):
    return sel.unresolved_store_warning(_annotated(inputs(spark, d)))


@query(
    "FLT7_unresolved_groups",
    """SELECT chrom || CASE WHEN pos % 100 = 7 THEN '-off' ELSE '-on' END AS sample_id, count(*) AS n_kept, count(*) FILTER (WHERE state <> 'unknown') AS n_resolved,
       count(*) >= 50 AND count(*) FILTER (WHERE state <> 'unknown') = 0 AS over_call_warning FROM freq_joined WHERE qc = 'PASS' GROUP BY 1""",
)
def _(spark, d):
    """Calls grouped by contig and by whether the store has their kind of position: some groups are never resolved."""
    place = F.when(c("pos") % 100 == 7, "-off").otherwise("-on")
    return sel.unresolved_store_warning(_annotated(inputs(spark, d)).withColumn("sample_id", F.concat("chrom", place)))


_FUNNEL = """SELECT sample_id, count(*) AS total_variants, count(*) FILTER (WHERE filter_status = 'PASS') AS pass_filter,
  count(*) FILTER (WHERE kept) AS after_qc, count(*) FILTER (WHERE kept AND rare) AS after_rarity,
  count(*) FILTER (WHERE kept AND rare AND impact) AS after_impact, count(*) FILTER (WHERE kept AND rare AND impact) AS candidates
FROM flagged GROUP BY sample_id"""


@query("AGG6_funnel", _FUNNEL)
def _(spark, d):
    return sel.funnel(_annotated(inputs(spark, d), kept_only=False))


# --- intervals -------------------------------------------------------------------
@query("INT3_merge_intervals", 'SELECT chrom, start::BIGINT AS start, "end"::BIGINT AS "end" FROM merged_regions')
def _(spark, d):
    return iv.merge_intervals(inputs(spark, d).relation("regions"))


@query("INT4_interval_summary", 'SELECT count(*) AS n_regions, sum("end" - start)::BIGINT AS total_bases FROM merged_regions')
def _(spark, d):
    return iv.interval_summary(iv.merge_intervals(inputs(spark, d).relation("regions")))


_INSIDE = 'EXISTS (SELECT 1 FROM merged_regions m WHERE m.chrom = t.chrom AND t.pos - 1 >= m.start AND t.pos - 1 < m."end")'


@query("INT1_point_in_interval", f"SELECT sample_id, line_no, {_INSIDE} AS inside FROM calls t")
def _(spark, d):
    i = inputs(spark, d)
    merged = iv.merge_intervals(i.relation("regions"))
    return iv.flag_inside(i.calls, merged, ["sample_id", "line_no"]).select("sample_id", "line_no", "inside")


@query("INT2_restrict_sites", f"SELECT chrom, pos, ref, alt FROM freq_store t WHERE {_INSIDE}")
def _(spark, d):
    i = inputs(spark, d)
    merged = iv.merge_intervals(i.relation("regions"))
    return iv.restrict_to_intervals(i.relation("freq_store"), merged, ["ref", "alt"]).select("chrom", "pos", "ref", "alt")


@query(
    "INT5_lift_over",
    """SELECT sample_id, line_no, o AS outcome, CASE WHEN o = 'lifted' THEN chrom END AS chrom,
         CASE WHEN o = 'lifted' THEN CASE WHEN minus THEN 100000000000 - 1 - (500 + pos - 1) + 1 ELSE pos + 5000 END END AS pos,
         CASE WHEN o = 'lifted' THEN CASE WHEN minus THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END END AS ref,
         CASE WHEN o = 'lifted' THEN CASE WHEN minus THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END END AS alt
       FROM (SELECT *, chrom IN ('chr2', 'chr3') AS minus, CASE WHEN chrom = 'chr1' THEN 'unmapped' WHEN chrom = 'chr4' THEN 'ambiguous'
           WHEN chrom IN ('chr2', 'chr3') AND (length(ref) > 1 OR length(alt) > 1) THEN 'strand' ELSE 'lifted' END AS o FROM calls) x""",
)
def _(spark, d):
    calls = inputs(spark, d).calls.select("sample_id", "line_no", "chrom", "pos", "ref", "alt")
    lifted = iv.lift_over(calls, _chain_blocks(spark, d), ["sample_id", "line_no"])
    return lifted.select("sample_id", "line_no", "outcome", "chrom", "pos", "ref", "alt")


def _chain_blocks(spark, d):
    """Chain blocks from the part table: 4 kb of source per block, chr1 without a chain, chr4 twice."""
    part = spark.read.parquet(f"{d}/part.parquet")
    number = (c("p_partkey") % 22 + 1).cast("string")
    start = F.floor((1000 + (c("p_partkey") * 100) % 2000000000) / 4096) * 4096
    spans = part.select(F.concat(F.lit("chr"), number).alias("src_chrom"), F.explode(F.array(start, start + 4096)).alias("src_start")).distinct()
    minus = c("src_chrom").isin("chr2", "chr3")
    block = spans.where(c("src_chrom") != "chr1").select(
        "src_chrom", "src_start", (c("src_start") + 4096).alias("src_end"), c("src_chrom").alias("dst_chrom"),
        F.when(minus, c("src_start") + 500).otherwise(c("src_start") + 5000).alias("dst_start"),
        F.when(minus, "-").otherwise("+").alias("dst_strand"), F.lit(100000000000).alias("dst_size"),
    )
    return block.unionByName(block.where(c("src_chrom") == "chr4").withColumn("dst_chrom", F.lit("chr5")))


@query(
    "FLT8_lift_lines",
    """SELECT sample_id AS file, outcome, count(*) AS n_records FROM (
         SELECT sample_id, CASE WHEN chrom = 'chr1' THEN 'unmapped' WHEN chrom = 'chr4' THEN 'ambiguous'
           WHEN chrom IN ('chr2', 'chr3') AND (length(ref) > 1 OR length(alt) > 1 OR n_alts = 2) THEN 'strand' ELSE 'lifted' END AS outcome FROM calls
         UNION ALL SELECT sample_id, unnest(['malformed', 'malformed', 'unmapped']) FROM (SELECT DISTINCT sample_id FROM calls) s) x GROUP BY 1, 2""",
)
def _(spark, d):
    from locusflow.workload.source_queries import stored_call_lines

    lines = stored_call_lines(inputs(spark, d))
    return iv.lift_lines(lines, _chain_blocks(spark, d), ["file", "line_no"]).groupBy("file", "outcome").agg(rows("n_records"))


@query(
    "FLT8_lift_counts",
    """SELECT CASE WHEN chrom = 'chr1' THEN 'unmapped' WHEN chrom = 'chr4' THEN 'ambiguous'
         WHEN chrom IN ('chr2', 'chr3') AND (length(ref) > 1 OR length(alt) > 1) THEN 'strand' ELSE 'lifted' END AS outcome,
       count(*) AS n_records FROM calls GROUP BY 1""",
)
def _(spark, d):
    from locusflow.workload.registry import QUERIES

    return iv.lift_counts(QUERIES["INT5_lift_over"](spark, d))


# --- store reduction ---------------------------------------------------------------
@query("AGG8_highest_score_per_locus", "SELECT chrom, pos, ref, alt, am_pathogenicity, am_class FROM score_store")
def _(spark, d):
    return sb.highest_score_per_locus(inputs(spark, d).relation("score_rows"), "transcript_no")


_TWO = """(SELECT chrom, pos, ref, alt, af, 'exomes' AS callset FROM freq_store
  UNION ALL SELECT chrom, pos, ref, alt, CASE WHEN ac % 3 = 0 THEN NULL ELSE af * (1 + (ac % 5 - 2) / 10) END, 'genomes' FROM freq_store)"""


def _callsets(i):
    exomes = i.relation("freq_store").select("chrom", "pos", "ref", "alt", "af", "ac", "an", c("nhomalt").alias("hom"))
    scaled = c("af") * (1 + (c("ac") % 5 - 2) / 10)
    genomes = exomes.withColumn("af", F.when(c("ac") % 3 != 0, scaled))
    return sb.merged_callsets(exomes, genomes)


@query(
    "AGG9_collapse_duplicates",
    f"""SELECT chrom, pos, ref, alt, round(af, 9) AS af, callset FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt
        ORDER BY af DESC NULLS LAST, callset) AS rn FROM {_TWO} u) x WHERE rn = 1""",
)
def _(spark, d):
    collapsed = sb.collapse_duplicate_loci(_callsets(inputs(spark, d)), "callset")
    return collapsed.select("chrom", "pos", "ref", "alt", F.round("af", 9).alias("af"), "callset")


@query("SET1_union_callsets", f"SELECT callset, count(*) AS n, round(sum(af), 6) AS af_sum FROM {_TWO} u GROUP BY callset")
def _(spark, d):
    return _callsets(inputs(spark, d)).groupBy("callset").agg(rows("n"), F.round(F.sum("af"), 6).alias("af_sum"))


@query(
    "SET2_tolerant_union",
    """SELECT chrom, count(*) AS n, count(faf) AS n_faf95 FROM (SELECT chrom, faf95 AS faf FROM freq_store UNION ALL SELECT chrom, NULL FROM score_store) x GROUP BY chrom""",
)
def _(spark, d):
    i = inputs(spark, d)
    joined = sb.tolerant_union([i.relation("freq_store"), i.knowledge.missense])
    return joined.groupBy("chrom").agg(rows("n"), F.count("faf95").alias("n_faf95"))


@query("SET5_unique_variants", "SELECT DISTINCT chrom, pos, ref, alt FROM calls")
def _(spark, d):
    return sb.unique_variants(inputs(spark, d).calls)


@query(
    "AGG15_popmax",
    """SELECT key, round(coalesce(af, 0), 9) AS af, coalesce(ac, 0)::BIGINT AS ac, coalesce(an, 0)::BIGINT AS an, pop FROM (SELECT DISTINCT key FROM c1) k LEFT JOIN (
         SELECT * FROM (SELECT key, pop, sum(ac) AS ac, sum(an) AS an, sum(ac) / sum(an) AS af,
             row_number() OVER (PARTITION BY key ORDER BY sum(ac) / sum(an) DESC, pop) AS rn
           FROM c1 GROUP BY key, pop HAVING sum(an) >= 100 AND sum(ac) > 0) r WHERE rn = 1) b USING (key)""".replace(
        "c1",
        """(SELECT 'k' || l_partkey AS key, CASE l_linenumber % 5 WHEN 0 THEN 'afr' WHEN 1 THEN 'nfe' WHEN 2 THEN 'eas' WHEN 3 THEN 'sas' ELSE 'amr' END AS pop,
            CAST(l_quantity AS BIGINT) % 9 AS ac, CAST(l_quantity AS BIGINT) * 4 AS an FROM lineitem)""",
    ),
)
def _(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    n = c("l_quantity").cast("bigint")
    groups = F.array(*[F.lit(g) for g in ("AFR", "nfe", "eas", "sas", "amr")])
    counts = line.select(
        F.concat(F.lit("k"), "l_partkey").alias("key"),
        F.when(c("l_orderkey") % 2 == 0, "exome").otherwise("genome").alias("callset"),
        F.element_at(groups, (c("l_linenumber") % 5 + 1)).alias("group"),
        (n % 9).alias("ac"), (n * 4).alias("an"),
    )
    fin = counts.withColumns({"group": F.lit("fin"), "ac": c("an")})
    return sb.popmax(counts.unionByName(fin)).select("key", F.round("af", 9).alias("af"), "ac", "an", "pop")


@query(
    "AGG16_group_maximum",
    """SELECT chrom, pos, ref, alt, round(CASE WHEN ok THEN af_grpmax ELSE af END, 9) AS af, CASE WHEN ok THEN ac + 1 ELSE ac END AS ac,
         CASE WHEN ok THEN grpmax_pop END AS pop FROM (SELECT *, grpmax_pop <> 'fin' AND af_grpmax IS NOT NULL AS ok FROM freq_store) x""",
)
def _(spark, d):
    sites = inputs(spark, d).relation("freq_store").withColumns(
        {"grpmax": c("grpmax_pop"), "ac_grpmax": c("ac") + 1, "an_grpmax": c("an"), "nhomalt_grpmax": c("nhomalt")}
    )
    return sb.group_maximum(sites).select("chrom", "pos", "ref", "alt", F.round("af", 9).alias("af"), "ac", "pop")


_LOCAL_CHROM = "'chr' || split_part(key, '-', 1)"


@query(
    "AGG25_covered_contigs",
    f"""SELECT chrom FROM (SELECT chrom, count(*) % 3 <> 0 AS whole FROM freq_store GROUP BY chrom) e
        JOIN (SELECT {_LOCAL_CHROM} AS chrom, count(*) % 5 <> 0 AS whole FROM local_freq GROUP BY 1) g USING (chrom) WHERE e.whole AND g.whole""",
)
def _(spark, d):
    i = inputs(spark, d)
    exomes, genomes = i.relation("freq_store"), _local_callset(i)
    whole = lambda df, name, n: df.groupBy("chrom").agg((F.count(F.lit(1)) % n != 0).alias("complete")).withColumn("callset", F.lit(name))
    complete = whole(exomes, "exomes", 3).unionByName(whole(genomes, "genomes", 5))
    return sb.covered_contigs(sb.merged_callsets(exomes, genomes), complete)


def _local_callset(i):
    """The local table as a second call set of sites."""
    parts = F.split("key", "-")
    return i.relation("local_freq").select(
        F.concat(F.lit("chr"), parts[0]).alias("chrom"), parts[1].cast("int").alias("pos"), parts[2].alias("ref"), parts[3].alias("alt"),
        "af", F.lit(10).cast("bigint").alias("ac"), F.lit(3000).cast("bigint").alias("an"), F.lit(0).cast("bigint").alias("hom"),
    )


@query(
    "J17_two_callsets",
    f"""SELECT q.chrom, q.pos, q.ref, q.alt, round(coalesce(b.af, 0), 9) AS af, b.n IS NULL AS absent
        FROM (SELECT DISTINCT chrom, pos, ref, alt FROM calls) q LEFT JOIN (
          SELECT chrom, pos, ref, alt, max(af) AS af, count(*) AS n
          FROM (SELECT chrom, pos, ref, alt, CASE WHEN ac % 7 = 0 THEN 0 ELSE af END AS af FROM freq_store
            UNION ALL SELECT {_LOCAL_CHROM}, CAST(split_part(key, '-', 2) AS INT), split_part(key, '-', 3), split_part(key, '-', 4), af FROM local_freq) u
          GROUP BY chrom, pos, ref, alt) b
          ON q.chrom = b.chrom AND q.pos = b.pos AND q.ref = b.ref AND q.alt = b.alt
        WHERE q.chrom <> 'chr9' OR b.af > 0""",
)
def _(spark, d):
    i = inputs(spark, d)
    uncalled = c("ac") % 7 == 0  # in the first call set, but with no alleles
    exomes = i.relation("freq_store").withColumn("hom", c("nhomalt")).withColumns(
        {"af": F.when(uncalled, F.lit(0.0)).otherwise(c("af")), "an": F.when(uncalled, F.lit(0)).otherwise(c("an"))}
    )
    readable = i.relation("freq_store").select("chrom").distinct().select(
        "chrom", F.explode(F.array(F.lit("exomes"), F.lit("genomes"))).alias("callset")
    ).withColumn("readable", ~((c("chrom") == "chr9") & (c("callset") == "genomes")))
    found = sb.resolve_callsets(i.calls, sb.merged_callsets(exomes, _local_callset(i)), readable)
    return found.select("chrom", "pos", "ref", "alt", F.round("af", 9).alias("af"), "absent")


@query(
    "W7_first_per_gene",
    """SELECT gene, line_no FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY
        CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'start_lost') THEN 0 ELSE 1 END, pos, line_no, sample_id) AS rn FROM calls) x WHERE rn = 1""",
)
def _(spark, d):
    calls = inputs(spark, d).calls.withColumn("milder", ~cl.is_null_variant(c("consequence")))
    return first_per_key(calls.select("gene", "milder", "pos", "line_no", "sample_id"), ["gene"], ["milder", "pos", "line_no", "sample_id"]).select("gene", "line_no")


@query(
    "W8_first_row_per_key",
    "SELECT sample_id, chrom, min(line_no) AS line_no FROM calls GROUP BY sample_id, chrom",
)
def _(spark, d):
    return first_per_key(inputs(spark, d).calls.select("sample_id", "chrom", "line_no"), ["sample_id", "chrom"], ["line_no"])


@query(
    "W9_one_record_per_locus",
    """SELECT chrom, pos, ref, alt, accession FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY n DESC) AS rn FROM (
         SELECT chrom, pos, ref, alt, accession, 1 AS n FROM assertion_store
         UNION ALL SELECT chrom, pos, ref, alt, accession || 'b', 2 FROM assertion_store WHERE significance <> '') u) x WHERE rn = 1""",
)
def _(spark, d):
    store = inputs(spark, d).relation("assertion_store").select("chrom", "pos", "ref", "alt", "accession", "significance").withColumn("n", F.lit(1))
    later = store.where(c("significance") != "").withColumns({"accession": F.concat("accession", F.lit("b")), "n": F.lit(2)})
    return sb.last_record_per_locus(store.unionByName(later), "n").select("chrom", "pos", "ref", "alt", "accession")

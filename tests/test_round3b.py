"""Ranking, lent phenotypes and gene evidence move only what their results read."""

from pyspark.sql import functions as F

from locusflow.operators import evaluation as evl
from locusflow.operators.evidence import gene_profile, with_gene_profile
from locusflow.operators.phenotype import inheritance_modes
from locusflow.operators.routing import ROUTED_ON, route
from locusflow.operators.selection import rank_candidates
from locusflow.plans.interpretation import ranked_candidates, with_lent_phenotypes
from locusflow.workload.inputs import inputs

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranking_needs_no_classification(spark):
    i = inputs(spark, FOLDER)
    ranked = ranked_candidates(i.found, i.patient_terms, i.knowledge)
    keys = ["sample_id", "line_no", "alt_index", "candidate_rank"]
    want = rank_candidates(i.classified()).select(*keys)
    assert ranked.count() and sorted(ranked.select(*keys).collect()) == sorted(want.collect())
    assert "rule_path" not in plan(ranked) and "hgvs_p" not in plan(ranked)


def test_lent_phenotypes_are_worked_out_for_the_asked_genes_only(spark):
    i = inputs(spark, FOLDER)
    lent = evl.decoy_pairs(i.relation("cases"), ["case_no"])
    key = i.relation("answer_key")
    asked = with_lent_phenotypes(i.found, i.patient_terms, lent, i.knowledge, asked=key, columns=ROUTED_ON)
    every = with_lent_phenotypes(i.found, i.patient_terms, lent, i.knowledge)
    assert 0 < asked[1].count() < every[1].count() and asked[0].count() == every[0].count()
    signals = [evl.with_decoy_signals(key, *runs) for runs in (asked, every)]
    a, b = (sorted(map(str, s.select(sorted(s.columns)).collect())) for s in signals)
    assert a and a == b


def test_gene_profile_and_second_hits_do_not_move_the_calls(spark):
    i = inputs(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where file sizes say little
    try:
        k = i.knowledge
        profile = gene_profile(i.found, k.constraint, k.haploinsufficient, inheritance_modes(k.gene_terms), k.secondary_genes)
        joined = with_gene_profile(i.found, profile)
        routed = route(i.classified())
        for df in (joined, routed):
            shown = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in shown and "hashpartitioning" not in shown
        assert joined.count() == i.found.count() and routed.where(F.col("second_hit").isNull()).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

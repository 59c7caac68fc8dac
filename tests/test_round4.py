"""What ranks write and move does not grow with the columns of a classified call."""

from pyspark.sql import functions as F

from locusflow.operators import ranking
from locusflow.operators.routing import rank_report
from locusflow.operators.selection import rank_candidates
from locusflow.workload.catalog import all_queries
from locusflow.workload.inputs import forget, inputs

FOLDER = "/root/testdata/sf0.001"
WIDE = {"rule_path", "met_codes", "hgvs_p", "clinvar_accession", "clinvar_condition", "modes", "exon"}


def rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


def ranked_from(monkeypatch, spark, name: str):
    """The query's result and the columns of what its ranks wrote, starting from the tables."""
    written, store = [], ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda df: written.append(set(df.columns)) or store(df))
    forget()
    got = all_queries()[name](spark, FOLDER)
    assert written and not any(columns & WIDE for columns in written)
    return got


def test_planted_ranks_need_no_classification(monkeypatch, spark):
    got = ranked_from(monkeypatch, spark, "W5_planted_rank")
    i = inputs(spark, FOLDER)
    assert "classified" not in i._kept
    best = rank_candidates(i.classified()).groupBy("sample_id", "gene").agg(F.min("candidate_rank").alias("best_rank"))
    want = i.relation("answer_key").join(best, ["sample_id", "gene"], "left").select(*got.columns)
    assert got.where("best_rank is not null").count() and rows(got) == rows(want)


def test_report_order_moves_only_what_it_orders_by(monkeypatch, spark):
    got = ranked_from(monkeypatch, spark, "W2_report_order")
    want = rank_report(inputs(spark, FOLDER).classified()).select(*got.columns)
    assert got.count() and rows(got) == rows(want)
    ranked_from(monkeypatch, spark, "W3_vus_ranking")

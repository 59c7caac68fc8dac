"""One nested result document a sample, in bounded parts."""

import json

from pyspark.sql import functions as F

from locusflow.operators.explore import overview, sample_documents
from locusflow.operators.sinks import write_documents

ROUTED = (
    "sample_id string, line_no int, alt_index int, gene string, consequence string, hgvs_p string, hgvs_c string, tier string, rule_path string, bucket string, "
    "carrier boolean, probable_vus boolean, hpo_match_score double, not_to_dismiss boolean, chrom string, pos int, ref string, alt string, "
    "clinvar_significance string, clinvar_review_status string, clinvar_accession string, build string"
)


def routed_row(sample, n, bucket="other", flag=False, vus=False):
    return (sample, n, 0, f"G{n}", "x", None, "c.1", "Pathogenic", "r", bucket, False, vus, 0.5, flag, "chr1", n, "A", "C", "Pathogenic", "", "V", "GRCh38")


def test_documents_are_cut_into_parts_and_written(spark, tmp_path):
    rows = [routed_row("s", n, "primary" if n % 4 == 0 else "other", n == 5, n == 6) for n in range(10)] + [routed_row("t", 1)]
    routed = spark.createDataFrame(rows, ROUTED)
    said = [("s", k, "next steps", None, f"d{k}") for k in range(1, 3)] + [("u", 11, "next steps", None, "d")]
    conclusions = spark.createDataFrame(said, "sample_id string, section_no int, section string, gene string, detail string")
    terms = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "a"), ("u", "c")], "sample_id string, term string")
    documents = sample_documents(routed, conclusions, terms, most=4)
    by_key = {(r["sample_id"], r["part"]): r for r in documents.collect()}
    assert set(by_key) == {("s", 0), ("s", 1), ("s", 2), ("t", 0), ("u", 0)}
    assert [f["line_no"] for p in range(3) for f in by_key["s", p]["findings"]] == list(range(10))
    assert all(len(r["findings"]) <= 4 and r["n_findings"] == len(r["findings"]) for r in by_key.values())
    head = by_key["s", 1]
    assert (head["hpo_terms"], head["n_candidates"], head["build"]) == (["a", "b"], 10, "GRCh38")
    assert head["buckets"]["primary"] == ["G4"] and head["buckets"]["probable_pathogenic_vus"] == ["G6"]
    assert [x["variant"] for x in head["not_to_dismiss"]] == ["1-5-A-C"] and head["conclusion"] == []
    alone = by_key["u", 0]
    assert alone["findings"] == [] and alone["buckets"]["other"] == [] and alone["conclusion"][0]["section"] == "next steps"
    write_documents(documents, str(tmp_path / "out"), most_rows=2)
    held = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {(x["sample_id"], x["part"]) for x in held} == set(by_key) and all("build" in x for x in held)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("*.json")) <= 2
    digest = {r["sample_id"]: r for r in overview(spark.read.json(str(tmp_path / "out"))).collect()}
    assert digest["s"]["n_primary"] == 3 and digest["s"]["n_not_to_dismiss"] == 1 and [x["detail"] for x in digest["s"]["conclusion"]] == ["d1", "d2"]
    assert sample_documents(routed.where(F.lit(False)), conclusions.limit(0), terms).count() == 0

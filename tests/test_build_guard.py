"""Evidence by coordinate is dropped for another build, and every source is recorded."""

from locusflow.plans.interpretation import find_candidates
from locusflow.workload.inputs import Inputs
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
EVIDENCE = ["gnomad_af", "clinvar_significance", "am_pathogenicity", "revel", "cadd_phred"]


def test_other_builds_lose_coordinate_evidence(spark):
    i = Inputs(spark, FOLDER)
    calls = i.calls if "build" not in i.calls.columns else i.calls.drop("build")
    build = F.element_at(F.array(F.lit("GRCh38"), F.lit("GRCh37"), F.lit(None)), (F.abs(F.hash("pos", "sample_id")) % 3 + 1).cast("int"))
    info = F.when(F.col("pos") % 2 == 0, F.create_map(F.lit("REVEL"), F.lit("0.9"))).otherwise(F.expr("map_filter(map('a', 'b'), (k, v) -> false)"))
    calls = calls.withColumns({"build": build, "info": info, "alt_index": F.lit(0)})
    found = find_candidates(calls, i.knowledge, carried=True).cache()
    other, own = found.where("build = 'GRCh37'"), found.where("build IS NULL OR build = 'GRCh38'")
    assert other.count() and own.count()
    assert all(other.where(F.col(c).isNotNull()).isEmpty() for c in EVIDENCE)
    assert other.where(F.exists(F.map_values("evidence_source"), lambda s: s != "none")).isEmpty()
    assert {r[0] for r in other.select("build_warning").distinct().collect()} == {"mismatch"}
    for name, column in (("missense", "am_pathogenicity"), ("gnomad", "gnomad_af")):
        source = F.element_at("evidence_source", name)
        assert own.where(F.col(column).isNotNull() & (source == "none")).isEmpty()
    in_store = own.where(F.col("revel").isNotNull() | F.col("cadd_phred").isNotNull())
    assert in_store.where(F.element_at("evidence_source", "insilico") == "none").isEmpty()

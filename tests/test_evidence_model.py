"""Golden evidence sets, criterion edge cases and monotonicity of the combiner."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from locusflow.operators.combine import classify, combine
from locusflow.settings import DEFAULTS, TIERS

P, LP, V, LB, B = TIERS
SETS = [
    ("PVS1:very_strong PS1:strong", P),
    ("PVS1:very_strong PM1:moderate PM2:moderate", P),
    ("PVS1:very_strong PM2:moderate PP3:supporting", P),
    ("PVS1:very_strong PP3:supporting PP4:supporting", P),
    ("PS1:strong PS3:strong", P),
    ("PS1:strong PM1:moderate PM2:moderate PM4:moderate", P),
    ("PVS1:very_strong", V),
    ("PVS1:very_strong PM2:supporting", LP),
    ("PVS1:very_strong PM2:moderate", LP),
    ("PS1:strong PM2:moderate", LP),
    ("PS1:strong PP3:supporting PP4:supporting", LP),
    ("PM1:moderate PM2:moderate PM4:moderate", LP),
    ("PM1:moderate PM2:moderate PP3:supporting PP4:supporting", LP),
    ("PM2:moderate PP3:supporting", V),
    ("BA1:stand_alone", B),
    ("BS1:strong BS2:strong", B),
    ("BS1:strong BP4:supporting", LB),
    ("BP4:supporting BP7:supporting", LB),
    ("BS1:strong", V),
    ("PVS1:very_strong PM2:moderate BA1:stand_alone", V),
    ("", V),
]
CODES = ["PVS1", "PS1", "PS3", "PM1", "PM2", "PM4", "PP3", "PP4", "BA1", "BS1", "BS2", "BP4", "BP7"]


def tiers(spark, texts, t=DEFAULTS):
    given = spark.createDataFrame([(x, dict(e.split(":") for e in x.split())) for x in texts], "name string, e map<string,string>")
    called = combine(given, {c: F.element_at("e", c) for c in CODES}, t)
    return {r["name"]: (r["tier"], r["rule_path"]) for r in called.collect()}


def test_golden_sets(spark):
    got = tiers(spark, [s for s, _ in SETS])
    assert {s: got[s][0] for s, _ in SETS} == dict(SETS)
    assert got[""][1].startswith("no criteria met => ")
    assert got["PVS1:very_strong PS1:strong"][1] == "PVS1 + PS1 => Pathogenic [PATH-1 (PVS1 + strong/moderate/supporting)]"


def test_points_model(spark):
    got = tiers(spark, ["PVS1:very_strong PM2:moderate", "BS1:strong BP4:supporting", "BA1:stand_alone"], replace(DEFAULTS, model="clingen"))
    assert got["PVS1:very_strong PM2:moderate"] == (P, "PVS1 + PM2 => +10 points (ClinGen/Tavtigian) => Pathogenic")
    assert got["BS1:strong BP4:supporting"][0] == LB and got["BA1:stand_alone"][0] == B


def test_more_pathogenic_evidence_never_lowers_the_tier(spark):
    base = ["PM2:supporting", "PVS1:very_strong", "PS1:strong PM2:moderate", "PM1:moderate PM4:moderate"]
    got = tiers(spark, base + [b + " PP3:supporting PP4:supporting" for b in base])
    for b in base:
        assert TIERS.index(got[b + " PP3:supporting PP4:supporting"][0]) <= TIERS.index(got[b][0])


CALLS = "name string, gene string, consequence string, exon string, gnomad_af double, abraom_af double, gnomad_faf95 double, lof_intolerant boolean, modes array<string>, am_pathogenicity double, revel double, cadd_phred double"
ROWS = [
    ("lof", "G", "stop_gained", "2/9", 0.0, None, None, True, [], None, None, None),
    ("last", "G", "frameshift_variant", "9/9", 0.0, None, None, True, [], None, None, None),
    ("start", "G", "start_lost", "1/9", None, None, None, True, [], None, None, None),
    ("stoplost", "G", "stop_lost", None, None, None, None, True, [], None, None, None),
    ("unknown_af", "G", "missense_variant", None, None, None, None, None, [], None, None, None),
    ("local_common", "G", "missense_variant", None, 0.0, 0.02, None, None, [], None, None, None),
    ("carrier_af", "G", "missense_variant", None, 0.005, None, None, None, ["AD", "AR"], None, None, None),
    ("conflict", "G", "missense_variant", None, None, None, None, None, [], None, 0.9, 5.0),
    ("am_wins", "G", "missense_variant", None, None, None, None, None, [], 0.1, 0.9, 30.0),
]


@pytest.fixture(scope="module")
def met(spark):
    called = classify(spark.createDataFrame(ROWS, CALLS), explain=True)
    return {r["name"]: {k["code"]: k for k in r["criteria"]} for r in called.collect()}


def test_criterion_edges(met):
    strength = lambda name, code: met[name][code]["applied_strength"]
    assert strength("lof", "PVS1") == "very_strong" and strength("lof", "PM2") == "supporting"
    assert strength("last", "PVS1") == "strong" and strength("start", "PVS1") == "moderate"
    assert strength("stoplost", "PVS1") is None and strength("stoplost", "PM4") == "moderate"
    assert strength("unknown_af", "PM2") is None and met["unknown_af"]["PM2"]["confidence"] == "low"
    assert strength("unknown_af", "BA1") is None
    assert strength("local_common", "PM2") is None and strength("local_common", "BS1") == "strong"
    assert strength("carrier_af", "BS1") is None  # recessive cutoff protects carrier frequencies
    assert strength("conflict", "PP3") is None and strength("conflict", "BP4") is None
    assert strength("am_wins", "PP3") is None and strength("am_wins", "BP4") == "supporting"


def test_trail_is_complete(met):
    assert len(met["lof"]) == 21
    assert not met["lof"]["PS2"]["applies"] and met["lof"]["PS1"]["adjudicated_by"] == "model"

"""Operators whose shape exists for scale, compared with brute force."""

import random

from pyspark.sql import functions as F

from locusflow.operators import evidence as ev
from locusflow.operators.intervals import flag_inside, merge_intervals
from locusflow.operators.phenotype import ancestor_closure, best_matches
from locusflow.operators.ranking import position_in_group
from locusflow.operators.skew import lookup
from locusflow.operators.store_build import build_manifest, extend_store, read_store, write_store


def test_position_in_group_with_one_large_group(spark):
    rng = random.Random(5)
    rows = [("big" if n % 3 else f"s{n % 7}", rng.randrange(40), n) for n in range(4000)] + [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    got = position_in_group(df, ["g"], [F.col("v").desc(), F.col("n").asc()], "p").collect()
    groups = {}
    for g, v, n in rows:
        groups.setdefault(g, []).append((-v, n))
    want = {(g, n): i + 1 for g, items in groups.items() for i, (_, n) in enumerate(sorted(items))}
    assert {(r["g"], r["n"]): r["p"] for r in got} == want


def test_salted_lookup_equals_plain_join(spark):
    rows = [("hot" if n % 2 else (None if n % 5 == 0 else f"k{n % 9}"), n) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, n int")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, x int")
    salted = lookup(df, table, ["k"], ["n"], floor=100, fan=8)
    key = lambda r: (r["n"], r["k"], r["x"])
    assert sorted(map(str, map(key, salted.collect()))) == sorted(map(str, map(key, df.join(table, "k", "left").collect())))


def test_merge_and_membership(spark):
    rng = random.Random(1)
    spans = [("chr1", s := rng.randrange(3000), s + rng.randrange(1, 80)) for _ in range(300)]
    covered = {p for _, s, e in spans for p in range(max(0, s - 5), e + 5)}
    merged = merge_intervals(spark.createDataFrame(spans, "chrom string, start int, end int"), pad=5, bin_size=64)
    got = sorted((r["start"], r["end"]) for r in merged.collect())
    assert {p for s, e in got for p in range(s, e)} == covered
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    points = spark.range(1, 3300).select(F.lit("1").alias("chrom"), F.col("id").cast("int").alias("pos"))
    inside = flag_inside(points, merged, ["pos"], bin_size=128).where("inside").collect()
    assert {r["pos"] - 1 for r in inside} == {p for p in covered if p < 3299}


EDGES = [("a", "root"), ("b", "root"), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("b1", "a"), ("x", "y"), ("y", "x")]
IC = {"root": 0.0, "a": 1.0, "b": 1.5, "a1": 2.0, "a2": 3.0, "b1": 2.5, "x": 0.0, "y": 0.0}


def test_similarity_matches_pairwise_definition(spark):
    terms = spark.createDataFrame([(t,) for t in IC], "term string")
    closure = ancestor_closure(terms, spark.createDataFrame(EDGES, "child string, parent string"))
    up = {}
    for r in closure.collect():
        up.setdefault(r["term"], set()).add(r["ancestor"])
    assert up["b1"] == {"b1", "b", "a", "root"} and up["x"] == {"x", "y"}
    genes = {"G": ["a1", "b1"], "H": ["b", "x"], "I": ["a2", "root"]}

    def lin(p, g):
        if p == g:
            return 1.0
        total, shared = IC[p] + IC[g], up[p] & up[g]
        return min(1.0, 2 * max(IC[t] for t in shared) / total) if shared and total > 0 else 0.0

    want = {}
    for gene, own in genes.items():
        for p in IC:
            sim, term = min((-lin(p, g), g) for g in own)
            if sim < 0:
                want[gene, p] = (round(-sim, 9), term)
    gt = spark.createDataFrame([(g, t) for g, ts in genes.items() for t in ts], "gene string, term string")
    pairs = spark.createDataFrame([(g, p) for g in genes for p in IC], "gene string, term string")
    ic = spark.createDataFrame(list(IC.items()), "term string, ic double")
    got = {(r["gene"], r["term"]): (round(r["similarity"], 9), r["gene_term"]) for r in best_matches(pairs, gt, closure, ic).collect()}
    assert got == want
    plain = {(r["gene"], r["term"]): round(r["similarity"], 9) for r in best_matches(pairs, gt, closure, ic, name_terms=False).collect()}
    assert plain == {k: v[0] for k, v in want.items()}


SITE = "chrom string, pos int, ref string, alt string"


def test_frequency_never_invents_an_absence(spark):
    calls = spark.createDataFrame([("s", n, "1" if n < 4 else "chr2", p, "a", "c") for n, p in enumerate([10, 20, 30, 40, 50])], "sample_id string, line_no int, " + SITE)
    store = spark.createDataFrame([("chr1", 10, "A", "C", "PASS", 0.1), ("chr1", 20, "A", "C", "AC0", 0.9)], SITE + ", filter string, af double")
    regions = spark.createDataFrame([("chr1", 29, 30)], "chrom string, start long, end long")
    state = lambda cov, **skew: {r["pos"]: (r["frequency_state"], r["gnomad_af"]) for r in ev.with_frequency(calls, store, cov, **skew).collect()}
    base = {10: ("frequency", 0.1), 20: ("filtered", None)}
    unknown = ("unknown", None)
    assert state(ev.Coverage()) == {**base, 30: unknown, 40: unknown, 50: unknown}
    assert state(ev.Coverage("full", ("chr1",)), floor=1, fan=4) == {**base, 30: ("absent", 0.0), 40: ("absent", 0.0), 50: unknown}
    assert state(ev.Coverage("bed", ("chr1",), regions)) == {**base, 30: ("absent", 0.0), 40: unknown, 50: unknown}
    assert state(ev.Coverage("bed", ("chr1",))) == {**base, 30: unknown, 40: unknown, 50: unknown}


def test_store_write_swap_and_extension(spark, tmp_path):
    store = spark.createDataFrame([("chr1", 2, "A", "C", 0.1), ("chr1", 1, "A", "C", 0.2), ("chr2", 5, "G", "T", 0.3)], SITE + ", af double")
    path = str(tmp_path / "store")
    write_store(store, path)
    write_store(store.where("pos < 5"), path)
    assert read_store(spark, path).count() == 2
    manifest = build_manifest(read_store(spark, path), "gnomad", {"name": "x"}, "frozen")
    assert manifest["rows"] == 2 and manifest["chroms"] == ["chr1"]
    wanted = spark.createDataFrame([("chr1", None, None, "joint"), ("chr2", None, None, "joint")], "chrom string, region string, bed string, preset string")
    first = extend_store(store, str(tmp_path / "e"), wanted, str(tmp_path / "scopes"))
    assert read_store(spark, str(tmp_path / "e")).count() == 3 and first is not None
    again = extend_store(store.where("false"), str(tmp_path / "e"), wanted, str(tmp_path / "scopes"))
    assert again.count() == 0 and read_store(spark, str(tmp_path / "e")).count() == 3

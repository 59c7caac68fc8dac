"""Stores laid out by locus: commits by version, joins without an exchange, Bloom pruning, heavy loci."""

import json
import re

import pytest
from pyspark.sql import functions as F

from locusflow.functions.keys import LOCUS
from locusflow.operators import evidence as ev
from locusflow.operators import laid_store as ls
from locusflow.operators.bloom import MOST_WORDS, bloom_filter, pruned, word_count
from locusflow.operators.health import readiness, store_measures, store_status
from locusflow.operators.skew import attach, heavy_hashes, lookup

SITE = "chrom string, pos int, ref string, alt string"
SCOPE = {"region": None, "bed": None, "preset": "joint"}


def plan_of(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def site_rows(n):
    return [(f"chr{1 + i % 3}", 100 + i, "acgt"[i % 4], "C", i / 1000) for i in range(n)]


def test_versions_keep_the_old_content_until_the_new_is_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    store = spark.createDataFrame(site_rows(60), SITE + ", af double")
    assert ls.manifest(spark, path) is None
    assert ls.write_version(store, path, "gnomad", buckets=4) == 1
    assert ls.write_version(store.where("pos < 130"), path, "gnomad", buckets=4) == 2
    assert ls.read_version(spark, path).count() == 30 and ls.read_version(spark, path, version=1).count() == 60
    one = ls.read_version(spark, path, contigs=["1"])
    assert {r["chrom"] for r in one.collect()} == {"chr1"} and one.columns == [*LOCUS, "chrom", "pos", "ref", "alt", "af"]
    held = ls.manifest(spark, path)
    assert held["rows"] == 30 and {c: x["rows"] for c, x in held["contigs"].items()} == {"chr1": 10, "chr2": 10, "chr3": 10}
    with pytest.raises(ls.StoreConflict):
        ls.commit(spark, path, held, after=1)  # another build has become version 2 meanwhile
    assert ls.versions(spark, path) == [1, 2] and not [x for x in ls.Folder(spark, path).names("versions") if x.startswith("draft")]
    gone = ls.drop_versions(spark, path, keep=1)
    assert len(gone) == 1 and ls.versions(spark, path) == [2] and ls.read_version(spark, path).count() == 30


def test_a_rename_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = spark.createDataFrame(site_rows(12), SITE + ", af double")
    ls.write_version(store, path, buckets=2)
    monkeypatch.setattr(ls.Folder, "rename", lambda self, old, new: False)
    with pytest.raises(ls.StoreConflict):
        ls.write_version(store.limit(1), path, buckets=2)
    with pytest.raises(ls.StoreConflict):
        ls.extend_version(store, path, {"chr1": {**SCOPE, "bed": "x.bed"}}, buckets=2)
    assert ls.versions(spark, path) == [1] and ls.read_version(spark, path).count() == 12


def test_a_narrowed_scope_may_leave_a_contig_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    store = spark.createDataFrame(site_rows(30), SITE + ", af double")
    wanted = {c: SCOPE for c in ("chr1", "chr2", "chr3")}
    assert ls.extend_version(store, path, wanted, buckets=2) == ["chr1", "chr2", "chr3"]
    assert ls.extend_version(store.where("false"), path, wanted, buckets=2) == []  # nothing pending, nothing read
    narrow = {**wanted, "chr2": {**SCOPE, "bed": "panel.bed"}}
    assert ls.extend_version(store.where("chrom <> 'chr2'"), path, narrow, buckets=2) == ["chr2"]
    assert {r["chrom"] for r in ls.read_version(spark, path).collect()} == {"chr1", "chr3"}
    held = ls.manifest(spark, path)["contigs"]["chr2"]
    assert held == {"folder": None, "rows": 0, "scope": {"region": None, "bed": "panel.bed", "preset": "joint"}}
    with pytest.raises(ls.StoreConflict):
        ls.extend_version(store, path, wanted, buckets=4)


def test_an_empty_store_can_be_committed_and_read(spark, tmp_path):
    path = str(tmp_path / "store")
    ls.write_version(spark.createDataFrame([], SITE + ", af double"), path, buckets=2)
    assert ls.read_version(spark, path).count() == 0 and ls.version_measures(spark, path).count() == 0


def test_health_follows_the_manifest(spark, tmp_path):
    paths = {"gnomad": str(tmp_path / "g"), "clinvar": str(tmp_path / "c"), "alphamissense": str(tmp_path / "none")}
    contigs = [f"chr{x}" for x in [*range(1, 23), "X", "Y"]]
    rows = [(c, 5 + i, "A", "C", 0.1) for i, c in enumerate(contigs)]
    store = spark.createDataFrame(rows, SITE + ", af double")
    ls.write_version(store, paths["gnomad"], "gnomad", buckets=2)
    named = store.withColumns({"significance": F.lit("Benign"), "review_status": F.lit(""), "review_stars": F.lit(1)})
    ls.write_version(named, paths["clinvar"], "clinvar", cadence="weekly", buckets=2, built_at="2024-01-01T00:00:00+00:00")
    assert ls.manifest(spark, paths["clinvar"])["stale_after_days"] == 14
    measures = store_measures(ls.read_version(spark, paths["gnomad"]), "gnomad")
    measures = measures.unionByName(store_measures(ls.read_version(spark, paths["clinvar"]), "clinvar"))
    status = store_status(measures, ls.manifest_rows(spark, paths), F.lit("2024-03-01").cast("timestamp"))
    assert {r["store"]: r["status"] for r in status.collect()} == {"gnomad": "ok", "clinvar": "stale", "alphamissense": "missing"}
    assert readiness(status).first().asDict() == {"ready": False, "blocking": ["alphamissense"], "stale": ["clinvar"]}
    footers = ls.version_measures(spark, paths["gnomad"])
    assert {(r["contig"], r["rows"], r["first_pos"], r["last_pos"]) for r in footers.collect()} == {(c, 1, p, p) for c, p, *_ in rows}


def test_join_reads_the_store_where_it_lies(spark, tmp_path):
    path = str(tmp_path / "store")
    ls.write_version(spark.createDataFrame(site_rows(300), SITE + ", af double"), path, buckets=8)
    calls = spark.range(900).select(
        F.lit("s").alias("sample_id"), F.col("id").alias("line_no"), F.concat(F.lit("chr"), 1 + F.col("id") % 2).alias("chrom"),
        (100 + F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 400)).cast("int").alias("pos"),
        F.element_at(F.array(*map(F.lit, "ACGT")), (F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 4) + 1).cast("int")).alias("ref"),
        F.when(F.col("id") % 7 == 0, "g").otherwise("c").alias("alt"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for floor in (1 << 40, 100):
            store = ls.read_version(spark, path, contigs=["chr1", "chr2"])
            joins = ev.join_frequency(ev.LocusJoins(calls, floor=floor), store)
            joined = joins.done()
            plan = plan_of(joined)
            assert re.search(r"PartitionFilters: \[contig#\d+ IN \(chr1,chr2\)", plan)
            assert "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
            # One exchange, of the calls; with heavy loci one broadcast of their rows besides.
            assert len(re.findall(r"Arguments: hashpartitioning", plan)) == 1
            assert ("BroadcastHashJoin" in plan) == (floor == 100)
            got = sorted((r["line_no"], r["store_af"]) for r in joined.collect())
            held = {(c, p, r.upper()): af for c, p, r, _, af in site_rows(300)}
            want = sorted((r["line_no"], held.get((r["chrom"], r["pos"], r["ref"])) if r["alt"] == "c" else None) for r in calls.collect())
            assert [x[0] for x in got] == [x[0] for x in want] and got == want
            assert sum(x[1] is not None for x in got) > 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bloom_filter_prunes_the_store_before_its_shuffle(spark):
    store = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for some in (0, 10, 300):
        wanted = spark.range(some).select((F.col("id") * 97 % 50_000).alias("k"))
        left = pruned(store, wanted, ["k"], least_bytes=0)
        assert left.columns == store.columns
        kept = {r["k"] for r in left.collect()}
        want = {i * 97 % 50_000 for i in range(some)} & set(range(40_000))
        assert want <= kept and len(kept) <= len(want) + 0.05 * 40_000
    assert pruned(store, wanted, ["k"]) is store  # a small store is joined as it is
    assert word_count(10**12) == MOST_WORDS and word_count(0) == 16
    assert bloom_filter(store, ["k"], 64).count() == 64


def test_candidates_decide_how_much_of_a_store_is_shuffled(spark, tmp_path):
    def shuffled(some):
        folder = str(tmp_path / f"events{some}")
        store = spark.range(50_000).select(F.lit("chr1").alias("locus_chrom"), F.col("id").cast("int").alias("locus_pos"), F.lit("A").alias("locus_ref"), F.lit("C").alias("locus_alt"), F.rand(1).alias("am"))
        rows = store.where(F.col("locus_pos") % (50_000 // some) == 0).select(*LOCUS)
        left = pruned(store, rows, LOCUS, least_bytes=0)
        left.repartition(3, *LOCUS).write.parquet(folder)
        return spark.read.parquet(folder).count()

    few, many = shuffled(50), shuffled(5000)
    assert 50 <= few < 1500 and 5000 <= many < 8000


def test_heavy_keys_come_from_a_sketch(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("g"))
    plain = spark.createDataFrame([(-1,)], "k bigint").select(F.xxhash64(F.col("k"), F.lit("x"))).first()[0]
    assert heavy_hashes(rows, ["k", "g"], floor=1000) == [plain] and heavy_hashes(rows, ["k", "g"]) == []
    assert heavy_hashes(rows.limit(0), ["k"]) == []
    table = spark.range(-1, 500).select(F.col("id").alias("k"), (F.col("id") + 5).alias("v"), F.lit(None).cast("string").alias("w"))
    got = lookup(rows, table, ["k"], ["k"], floor=1000)
    assert got.columns == ["k", "g", "v", "w"] and got.count() == 60_000
    assert got.where("k < 500 AND v = k + 5").count() == rows.where("k < 500").count() and got.where("k >= 500 AND v IS NOT NULL").count() == 0


def test_a_small_table_goes_to_wide_rows(spark):
    rows = spark.range(50).select((F.col("id") % 5).alias("file"), F.col("id").alias("n"))
    table = spark.createDataFrame([(i, "h" * 20) for i in range(4)], "file bigint, head string")
    want = sorted((r["n"], None if r["file"] == 4 else "h" * 20) for r in rows.collect())
    for most in (1 << 20, 0):
        joined = attach(rows, table, ["file"], ["n"], most)
        assert sorted((r["n"], r["head"]) for r in joined.collect()) == want
        assert ("BroadcastHashJoin" in plan_of(joined)) or most == 0


def test_bed_coverage_joins_the_store_once(spark, tmp_path):
    calls = spark.createDataFrame([("s", n, "1", p, "A", "C") for n, p in enumerate([1, 29, 30, 31, 64, 65, 4096, 4097, 9000])], "sample_id string, line_no int, " + SITE)
    store_path = str(tmp_path / "stored")
    spark.createDataFrame([("chr1", 30, "A", "C", 0.1)], SITE + ", af double").write.parquet(store_path)
    regions = spark.createDataFrame([("chr1", 0, 1), ("chr1", 29, 31), ("chr1", 63, 64), ("chr1", 4095, 4097)], "chrom string, start long, end long")
    joined = ev.with_frequency(calls, spark.read.parquet(store_path), ev.Coverage("bed", ("chr1",), regions))
    assert len(re.findall(r"Location: [^\n]*stored", plan_of(joined))) == 1
    state = {r["pos"]: r["frequency_state"] for r in joined.collect()}
    assert state == {1: "absent", 29: "unknown", 30: "frequency", 31: "absent", 64: "absent", 65: "unknown", 4096: "absent", 4097: "absent", 9000: "unknown"}


def test_manifest_is_plain_json(spark, tmp_path):
    path = str(tmp_path / "store")
    ls.write_version(spark.createDataFrame(site_rows(3), SITE + ", af double"), path, "alphamissense", {"release": "r1"}, buckets=2)
    text = (tmp_path / "store" / "versions" / "00000001.json").read_text()
    held = json.loads(text)
    assert held["version"] == 1 and held["source"] == {"release": "r1"} and held["buckets"] == 2 and held["stale_after_days"] is None
    assert [f["name"] for f in held["columns"]["fields"]] == ["chrom", "pos", "ref", "alt", "af"]

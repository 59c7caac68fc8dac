"""Steps that stored or moved more than the job needs, and terms without information."""

from pyspark.sql import functions as F

from locusflow.operators.combine import classify, explained

FOLDER = "/root/testdata/sf0.001"


def test_trail_is_worked_out_where_it_is_read(spark):
    from locusflow.operators.durable import durable
    from locusflow.workload.inputs import inputs

    rows = [("a", "stop_gained", None, 0.0), ("b", "missense_variant", 0.95, 0.2), ("c", None, None, None)]
    given = spark.createDataFrame(rows, "name string, consequence string, am_pathogenicity double, gnomad_af double")
    late = explained(durable(classify(given)))
    full = classify(given, explain=True).select(*late.columns)
    assert sorted(map(str, late.collect())) == sorted(map(str, full.collect()))
    few = explained(classify(given), fields=["code", "met"]).select("name", F.explode("criteria").alias("k")).select("name", "k.*")
    assert few.columns == ["name", "code", "met"]
    want = {(r["name"], k["code"], k["met"]) for r in full.collect() for k in r["criteria"]}
    assert {tuple(r) for r in few.collect()} == want
    held = inputs(spark, FOLDER)
    assert "criteria" not in held.classified().columns


def test_a_term_of_every_gene_still_matches_itself(spark, tmp_path):
    """Such a term has no information and no informative ancestor, but is identical to the gene's own."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from check_oracle import normal

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t}_given AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        source = f"SELECT * FROM {t}_given"
        if t == "orders":
            source = "SELECT g AS o_orderkey, c_custkey AS o_custkey FROM customer_given, range(150) r(g) WHERE c_custkey % 2 = 0"
        con.execute(f"COPY ({source}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    name = "W10_distinct_pair_similarity"
    got, want = queries()[name](spark, str(tmp_path)).toPandas(), con.execute(oracle_sql()[name]).df()
    assert len(want) > 150 and normal(got) == normal(want)


def test_stores_are_merged_by_tasks_that_follow_from_the_calls(spark):
    from locusflow.operators import evidence as ev

    plan = lambda df: df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    site = "chrom string, pos int, ref string, alt string"
    calls = spark.createDataFrame([("s", n, "chr1", n, "A", "C") for n in range(40)], f"sample_id string, line_no int, {site}")
    store = spark.createDataFrame([("chr1", n, "A", "C", n / 10) for n in range(20)], f"{site}, af double")
    joined = ev.join_frequency(ev.LocusJoins(calls, many=10), store).done()
    assert "BroadcastHashJoin" not in plan(joined) and "REPARTITION_BY_NUM" in plan(joined)
    assert {(r["line_no"], r["store_af"]) for r in joined.collect()} == {(n, n / 10 if n < 20 else None) for n in range(40)}
    assert "REPARTITION_BY_NUM" not in plan(ev.join_frequency(ev.LocusJoins(calls), store).done())


def test_similarities_go_to_the_listed_terms(spark, monkeypatch):
    from locusflow.operators import phenotype as ph

    moved = []
    kept = ph.attach
    monkeypatch.setattr(ph, "attach", lambda df, table, keys, spread_on: moved.append(keys) or kept(df, table, keys, spread_on))
    ic = spark.createDataFrame([("r", 0.0), ("a", 1.0), ("b", 2.0)], "term string, ic double")
    up = spark.createDataFrame([("a", "r"), ("b", "a")], "child string, parent string")
    closure = ph.ancestor_closure(ic.select("term"), up)
    genes = spark.createDataFrame([("G", "a"), ("H", "r")], "gene string, term string")
    pairs = spark.createDataFrame([("s", "G"), ("s", "H"), ("t", "G")], "sample_id string, gene string")
    listed = spark.createDataFrame([("s", "b"), ("s", "b"), ("s", "r"), ("t", "r")], "sample_id string, term string")
    got = ph.phenotype_scores(pairs, listed, genes, closure, ic).collect()
    assert moved == [["gene", "term"]]
    assert {tuple(r) for r in got} == {("s", "G", 0.444, 0.667, 2), ("s", "H", 0.333, 1.0, 1)}


def test_block_text_is_unpacked_once(spark):
    from __spark_entry__ import queries
    from locusflow.workload.inputs import inputs

    found = queries()["SRC2_block_gzip_calls"](spark, FOLDER)
    held = inputs(spark, FOLDER)
    assert found.count() == held.calls.count() and found.select("many_tasks").distinct().first()[0]
    assert held.keep("block gzip lines", lambda: None).count() == held.keep("call_lines", lambda: None).count()
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "MapInArrow" not in plan  # parsing starts from the lines as stored

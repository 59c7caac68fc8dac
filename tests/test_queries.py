"""A few registered queries against their SQL on the smallest folder, and registry checks."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracle import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
NAMES = ["AGG6_funnel", "J2_frequency_states", "AGG10_phenotype_score", "CB5_tier_and_rule_path", "RT1_finding_buckets", "INT3_merge_intervals", "W1_candidate_ranking"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries()[name](spark, FOLDER).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())

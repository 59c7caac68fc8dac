"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.durable import shared_path
from locusflow.operators.evidence import LocusJoins, join_frequency, with_frequency
from locusflow.operators.intervals import flag_inside, merge_intervals
from locusflow.operators.laid_store import read_version, write_version
from locusflow.operators.phenotype import (
    ancestor_closure, information_content, phenotype_scores, sample_gene_pairs,
)
from locusflow.operators.quality import passing_calls, sequencing_quality
from locusflow.operators.selection import rank_candidates
from locusflow.plans.interpretation import find_candidates
from locusflow.sources.vcf import parse_calls
from locusflow.workload.catalog import all_queries
from locusflow.workload.inputs import Inputs, forget
from locusflow.workload.source_queries import call_lines

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOCI = 10_000_000
PREPARED: dict[str, str] = {}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def phenotype(i: Inputs) -> DataFrame:
    """Similarity from the ontology up, for every gene called in every sample."""
    closure = ancestor_closure(i.relation("terms"), i.relation("is_a"))
    content = information_content(i.relation("terms"), i.relation("gene_terms"), closure)
    return phenotype_scores(sample_gene_pairs(i.calls), i.patient_terms, i.relation("gene_terms"), closure, content)


def inside(i: Inputs) -> DataFrame:
    return flag_inside(i.calls, merge_intervals(i.relation("regions")), ["sample_id", "line_no"])


def large_store(i: Inputs) -> None:
    """A store of about LOCI loci, committed before the clock starts: the frequency store at shifted positions."""
    store = i.relation("freq_store")
    copies = max(1, min(600, LOCI // store.count()))  # positions stay below 2**31
    shifted = store.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("pos", F.col("pos") + F.col("_j") * 3_000_000)
    PREPARED["store"] = shared_path(i.spark, "bench-store")
    write_version(shifted.drop("_j"), PREPARED["store"], "gnomad", buckets=64)


def laid_store_join(i: Inputs) -> DataFrame:
    """All passing calls against the large store, joined where it lies."""
    store = read_version(i.spark, PREPARED["store"], [f"chr{n}" for n in range(1, 23)])
    return join_frequency(LocusJoins(passing_calls(i.calls)), store).done()


def call_text(i: Inputs) -> None:
    PREPARED["lines"] = shared_path(i.spark, "bench-lines")
    call_lines(i.calls).repartition(16).write.parquet(PREPARED["lines"])


PREPARE = {"laid_store_join": large_store, "text_parse": call_text}
WORK = {
    "sequencing_quality": lambda i: sequencing_quality(i.calls),
    "frequency_join": lambda i: with_frequency(passing_calls(i.calls), i.relation("freq_store"), i.coverage),
    "funnel": lambda i: all_queries()["AGG6_funnel"](i.spark, i.sf_dir),
    "candidates": lambda i: find_candidates(i.calls, i.knowledge),
    "candidate_ranking": lambda i: rank_candidates(
        find_candidates(i.calls, i.knowledge).withColumn("hpo_match_score", F.lit(0.0))
    ),
    "point_in_interval": inside,
    "phenotype_score": phenotype,
    "whole_interpretation": lambda i: i.fresh_interpretation(),
    "text_parse": lambda i: parse_calls(i.spark.read.parquet(PREPARED["lines"])),
    "laid_store_join": laid_store_join,
}


def main() -> None:
    spark, seconds = session(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name, build in WORK.items():
        forget()
        PREPARE.get(name, lambda i: None)(Inputs(spark, FOLDER))
        started = time.time()
        build(Inputs(spark, FOLDER)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": FOLDER.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

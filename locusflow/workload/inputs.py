"""Frames the registered queries share."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.durable import durable, stored
from locusflow.operators.evidence import Coverage
from locusflow.operators.phenotype import ancestor_closure, information_content
from locusflow.operators.routing import route
from locusflow.operators.store_build import highest_score_per_locus
from locusflow.plans.interpretation import Knowledge, classify_candidates, find_candidates, interpret
from locusflow.sources.tables import intolerant
from locusflow.workload.relations import register_tables, spark_relation

REFERENCE_TABLES = (
    "is_a", "terms", "phenotype_terms", "gene_terms", "gene_constraint", "haploinsufficient", "secondary_genes",
)
COVERED = tuple(f"chr{n}" for n in range(1, 21))


class Inputs:
    """Relations and intermediate results over one data folder.

    Results several queries start from are written once per session, by column, so that each reads what it needs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}
        self._shared: dict[str, object] = {}
        self._relations: dict[str, DataFrame] = {}
        self._views = register_tables(spark, sf_dir)

    def relation(self, name: str) -> DataFrame:
        """A derived relation; the ontology and gene tables are stored once, as releases would be."""
        if name not in self._relations:
            derived = spark_relation(self.spark, self._views, name)
            self._relations[name] = durable(derived) if name in REFERENCE_TABLES else derived
        return self._relations[name]

    def keep(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = stored(build())
        return self._kept[name]

    def once(self, name: str, build):
        """Anything else that queries share, such as the path of a written store."""
        if name not in self._shared:
            self._shared[name] = build()
        return self._shared[name]

    @property
    def calls(self) -> DataFrame:
        return self.relation("calls")

    @property
    def coverage(self) -> Coverage:
        return Coverage("full", COVERED)

    @cached_property
    def knowledge(self) -> Knowledge:
        constraint = self.relation("gene_constraint")
        return Knowledge(
            frequency=self.relation("freq_store"),
            coverage=self.coverage,
            assertions=self.relation("assertion_store"),
            missense=highest_score_per_locus(self.relation("score_rows"), "transcript_no"),
            local_frequency=self.relation("local_freq"),
            predictors=self.relation("predictors"),
            constraint=constraint.withColumn("lof_intolerant", intolerant(F.col("pli"), F.col("loeuf"))),
            haploinsufficient=self.relation("haploinsufficient"),
            secondary_genes=self.relation("secondary_genes"),
            terms=self.relation("terms"),
            is_a=self.relation("is_a"),
            gene_terms=self.relation("gene_terms"),
        )

    @property
    def patient_terms(self) -> DataFrame:
        return self.relation("patient_terms")

    @property
    def closure(self) -> DataFrame:
        return self.keep("closure", lambda: ancestor_closure(self.relation("terms"), self.relation("is_a")))

    @property
    def content(self) -> DataFrame:
        return self.keep(
            "content", lambda: information_content(self.relation("terms"), self.relation("gene_terms"), self.closure)
        )

    @property
    def found(self) -> DataFrame:
        return self.keep("found", lambda: find_candidates(self.calls, self.knowledge))

    def classified(self) -> DataFrame:
        return self.keep("classified", lambda: classify_candidates(self.found, self.patient_terms, self.knowledge))

    def routed(self) -> DataFrame:
        return route(self.classified())

    def fresh_interpretation(self) -> DataFrame:
        """The whole job from the tables, sharing nothing with other queries."""
        return interpret(self.calls, self.patient_terms, self.knowledge)


@lru_cache(maxsize=4)
def _inputs(application: str, sf_dir: str) -> dict:
    return {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    held = _inputs(spark.sparkContext.applicationId, sf_dir)
    if "inputs" not in held:
        held["inputs"] = Inputs(spark, sf_dir)
    return held["inputs"]


def forget() -> None:
    """Drop shared results, so the next query starts from the tables."""
    _inputs.cache_clear()

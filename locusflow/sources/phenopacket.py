"""Case packets (nested JSON) as phenotype terms, variants and a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.consequences import literal_map
from locusflow.settings import ALLELIC_STATES

PACKET = """
subject struct<id:string>,
phenotypicFeatures array<struct<type:struct<id:string,label:string>,excluded:boolean>>,
interpretations array<struct<diagnosis:struct<
  disease:struct<id:string,label:string>,
  genomicInterpretations:array<struct<variantInterpretation:struct<variationDescriptor:struct<
    geneContext:struct<symbol:string>,
    expressions:array<struct<syntax:string,value:string>>,
    vcfRecord:struct<chrom:string,pos:string,ref:string,alt:string>,
    allelicState:struct<id:string,label:string>>>>>>>>,
diseases array<struct<term:struct<id:string,label:string>,excluded:boolean>>
"""


def read_phenopackets(spark: SparkSession, paths) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    return parse_phenopackets(raw)


def parse_phenopackets(documents: DataFrame) -> DataFrame:
    packet = documents.select("file", F.from_json("value", PACKET).alias("p")).select("file", "p.*")
    features = F.filter(
        "phenotypicFeatures",
        lambda f: ~F.coalesce(f["excluded"], F.lit(False)) & f["type"]["id"].startswith("HP:"),
    )
    descriptors = F.flatten(
        F.transform(
            F.coalesce("interpretations", F.array()),
            lambda i: F.transform(
                F.coalesce(i["diagnosis"]["genomicInterpretations"], F.array()),
                lambda g: g["variantInterpretation"]["variationDescriptor"],
            ),
        )
    )
    label = F.coalesce(
        _first_text(F.transform("interpretations", lambda i: i["diagnosis"]["disease"]["label"])),
        _first_text(
            F.transform(
                F.filter("diseases", lambda d: ~F.coalesce(d["excluded"], F.lit(False))),
                lambda d: d["term"]["label"],
            )
        ),
        F.lit(""),
    )
    located = lambda d: (
        (F.coalesce(d["vcfRecord"]["chrom"], F.lit("")) != "")
        & (F.coalesce(d["vcfRecord"]["pos"], F.lit("")) != "")
        & (F.coalesce(d["vcfRecord"]["ref"], F.lit("")) != "")
        & (F.coalesce(d["vcfRecord"]["alt"], F.lit("")) != "")
    )
    present = F.filter(F.col("descriptors"), lambda d: d.isNotNull())
    return packet.withColumn("descriptors", descriptors).select(
        "file",
        F.coalesce(F.when(F.col("subject.id") != "", F.col("subject.id")), F.lit("PHENOPACKET")).alias("subject_id"),
        F.coalesce(F.transform(features, lambda f: f["type"]["id"]), F.array().cast("array<string>")).alias("hpo_terms"),
        label.alias("disease"),
        F.transform(F.filter(present, located), _variant).alias("variants"),
        F.size(F.filter(present, lambda d: ~located(d))).alias("skipped_variants"),
    )


def _first_text(labels: Column) -> Column:
    return F.get(F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def _variant(d: Column) -> Column:
    states = literal_map(ALLELIC_STATES)
    expression = lambda syntax: F.element_at(
        F.transform(F.filter(d["expressions"], lambda e: e["syntax"] == syntax), lambda e: e["value"]), -1
    )
    first_or_null = lambda syntax: F.when(
        F.size(F.filter(d["expressions"], lambda e: e["syntax"] == syntax)) > 0, expression(syntax)
    )
    return F.struct(
        d["vcfRecord"]["chrom"].alias("chrom"),
        d["vcfRecord"]["pos"].try_cast("int").alias("pos"),
        d["vcfRecord"]["ref"].alias("ref"),
        d["vcfRecord"]["alt"].alias("alt"),
        d["geneContext"]["symbol"].alias("gene"),
        first_or_null("hgvs.c").alias("hgvs_c"),
        first_or_null("hgvs.p").alias("hgvs_p"),
        F.coalesce(
            F.element_at(states, d["allelicState"]["id"]),
            F.element_at(states, F.lower(d["allelicState"]["label"])),
        ).alias("zygosity"),
    )


def packet_variants(packets: DataFrame) -> DataFrame:
    return packets.select("subject_id", F.posexplode("variants").alias("variant_no", "v")).select(
        "subject_id", "variant_no", "v.*"
    )

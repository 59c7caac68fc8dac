"""Store health, readiness, file inventory and what evidence a file supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators.quality import passes_filter
from locusflow.settings import CORE_CONTIGS, GENOME_BUILD, INFO_ALIASES

c = F.col

REQUIRED_COLUMNS = {
    "gnomad": ("chrom", "pos", "ref", "alt", "af"),
    "alphamissense": ("chrom", "pos", "ref", "alt", "am_pathogenicity", "am_class"),
    "clinvar": ("chrom", "pos", "ref", "alt", "significance", "review_status", "review_stars"),
}
STALE_AFTER_DAYS = {"gnomad": None, "alphamissense": None, "clinvar": 14}
BLOCKING = ("missing", "corrupt", "incomplete")


def store_measures(store: DataFrame, name: str) -> DataFrame:
    """One row: rows, missing core contigs and whether all required columns exist."""
    core = F.array(*[F.lit(x) for x in CORE_CONTIGS])
    return store.agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("chrom")).alias("contigs")
    ).select(
        F.lit(name).alias("store"),
        "rows",
        F.size("contigs").alias("n_contigs"),
        F.sort_array(F.array_except(core, "contigs")).alias("missing_contigs"),
        F.lit(set(REQUIRED_COLUMNS[name]) <= {x.lower() for x in store.columns}).alias("schema_ok"),
    )


def store_status(measures: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """Status of every registered store from its measures and manifest.

    ``manifests`` has ``store, present, readable, rows_expected, built_at``; a store
    without measures is missing or corrupt. Staleness never hides incompleteness.
    """
    limits = F.create_map(*[x for k, v in STALE_AFTER_DAYS.items() for x in (F.lit(k), F.lit(v).cast("int"))])
    age = (F.unix_seconds(now) - F.unix_seconds(F.to_timestamp("built_at"))) / 86400.0
    limit = F.element_at(limits, c("store"))
    stale = F.coalesce(age > limit, F.lit(False))
    complete = (
        c("schema_ok") & (F.size("missing_contigs") == 0) & (c("rows_expected").isNull() | (c("rows") == c("rows_expected")))
    )
    return manifests.join(measures, "store", "left").select(
        "store",
        "rows",
        "rows_expected",
        F.round(age, 1).alias("age_days"),
        F.when(~c("present"), "missing")
        .when(~F.coalesce("readable", F.lit(False)) | c("rows").isNull(), "corrupt")
        .when(~F.coalesce(complete, F.lit(False)), "incomplete")
        .when(stale, "stale")
        .otherwise("ok")
        .alias("status"),
    )


def readiness(status: DataFrame) -> DataFrame:
    """One row: may an analysis run, what blocks it, what is merely old. One input row per store."""
    names = lambda test: F.sort_array(F.collect_list(F.when(test, c("store"))))
    return status.agg(
        names(c("status").isin(*BLOCKING)).alias("blocking"), names(c("status") == "stale").alias("stale")
    ).select((F.size("blocking") == 0).alias("ready"), "blocking", "stale")


def annotation_keys() -> list[str]:
    return sorted({"ANN", "CSQ", *[k for names in INFO_ALIASES.values() for k in names]})


def file_inventory(calls: DataFrame) -> DataFrame:
    """Per file: counts, how much is annotated, by what, and which INFO keys occur."""
    keys = F.map_keys("info")
    known = F.array(*[F.lit(k) for k in annotation_keys()])
    has = lambda name: F.array_contains(keys, name)
    counted = calls.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_variants"),
        F.count_if(passes_filter(c("filter_status"))).alias("pass_filter"),
        F.count_if(F.coalesce("consequence", F.lit("")) != "").alias("with_consequence"),
        F.count_if(has("ANN")).alias("_ann"),
        F.count_if(has("CSQ")).alias("_csq"),
        F.count_if(F.arrays_overlap(keys, known)).alias("_any"),
    )
    # Distinct (file, key) rows first: what is listed is the key names, not the calls.
    listed = (
        calls.select("file", F.explode(keys).alias("k"))
        .distinct()
        .groupBy("file")
        .agg(F.sort_array(F.collect_list("k")).alias("info_fields"))
    )
    bulk = lambda count: c(count) > c("total_variants") / 2
    source = (
        F.when(bulk("with_consequence"), "consequence")
        .when(bulk("_ann"), "SnpEff ANN")
        .when(bulk("_csq"), "VEP CSQ")
        .when(bulk("_any"), "population INFO")
    )
    none = F.array().cast("array<string>")
    return counted.join(listed, "file", "left").select(
        "file", "total_variants", "pass_filter", "with_consequence",
        F.round(c("with_consequence") / c("total_variants"), 4).alias("consequence_coverage"),
        source.isNotNull().alias("annotated"),
        source.alias("annotation_source"),
        F.coalesce("info_fields", none).alias("info_fields"),
        F.coalesce(F.array_intersect("info_fields", known), none).alias("annotation_fields"),
    )


def available_criteria(inventory: DataFrame, headers: DataFrame, stores: set[str], phenotype_given: bool) -> DataFrame:
    """Per file and group of criteria: available, limited or not applicable.

    ``stores`` names what is installed, out of gnomad, alphamissense, clinvar, hpo.
    """
    ann = c("annotated")
    status = lambda good: F.when(good, "available").otherwise("limited")
    have = lambda name: F.lit(name in stores)
    phenotype = (
        F.lit("available") if "hpo" in stores and phenotype_given
        else F.lit("limited") if "hpo" in stores
        else F.lit("na")
    )
    groups = {
        "PVS1": status(ann),
        "PM4": status(ann),
        "PP3 / BP4": status(ann & have("alphamissense")),
        "PM2 / BA1 / BS1": status(have("gnomad")),
        "PS1 / PM5 / PP5 / BP6": status(have("clinvar")),
        "PP4": phenotype,
        "PS2 / PM3 / PM6 / PP1 / BS4": F.lit("na"),
    }
    rows = [F.struct(F.lit(k).alias("criteria"), v.alias("status")) for k, v in groups.items()]
    mismatch = F.when(
        c("build").isNull() | (c("build") != GENOME_BUILD),
        F.struct(F.lit("build warning").alias("criteria"), F.lit("limited").alias("status")),
    )
    return (
        inventory.join(headers.select("file", "build"), "file", "left")
        .select("file", F.explode(F.array_compact(F.array(*rows, mismatch))).alias("r"))
        .select("file", "r.criteria", "r.status")
    )

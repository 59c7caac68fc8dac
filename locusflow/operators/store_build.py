"""Reduction of raw releases to one row per locus, and partitioned store writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.keys import LOCUS, prefixed_contig
from locusflow.operators import laid_store as ls
from locusflow.operators.health import STALE_AFTER_DAYS
from locusflow.operators.ranking import first_per_key
from locusflow.settings import CORE_CONTIGS, DEFAULTS, POPMAX_EXCLUDED, POPMAX_GROUPS, Thresholds

c = F.col
SITE = ["chrom", "pos", "ref", "alt"]


def highest_score_per_locus(scores: DataFrame, order: str) -> DataFrame:
    """Largest score of each locus with its class; the earliest row wins a tie."""
    best = F.struct((-c("am_pathogenicity")).alias("s"), c(order).alias("o"))
    return scores.groupBy(*SITE).agg(
        F.max("am_pathogenicity").alias("am_pathogenicity"), F.min_by("am_class", best).alias("am_class")
    )


def collapse_duplicate_loci(rows: DataFrame, order: str) -> DataFrame:
    """Row with the higher frequency per locus; NULL is lowest, the earliest row wins a tie."""
    keyed = rows.withColumns({"_unknown": c("af").isNull(), "_down": -c("af")})
    return first_per_key(keyed, SITE, ["_unknown", "_down", order]).drop("_unknown", "_down")


def last_record_per_locus(records: DataFrame, order: str) -> DataFrame:
    """Later records of a locus replace earlier ones."""
    values = [x for x in records.columns if x not in SITE]
    return records.groupBy(*SITE).agg(F.max_by(F.struct(*values), order).alias("_v")).select(
        *SITE, *[c(f"_v.{x}").alias(x) for x in values]
    )


def unique_variants(variants: DataFrame) -> DataFrame:
    return variants.select(*SITE).distinct()


def popmax(counts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Highest group frequency per variant over the included groups.

    ``counts`` has ``key, callset, group, ac, an``; counts of both callsets are added
    first. Groups below the minimum allele number, and frequencies of 0, never win.
    """
    per_group = (
        counts.where(F.lower("group").isin(*POPMAX_GROUPS))
        .groupBy("key", F.lower("group").alias("pop"))
        .agg(F.sum("ac").alias("ac"), F.sum("an").alias("an"))
        .withColumn("af", F.when(c("an") > 0, c("ac") / c("an")).otherwise(0.0))
    )
    eligible = (c("an") >= t.popmax_min_an) & (c("af") > 0)
    best = F.min(F.when(eligible, F.struct((-c("af")).alias("down"), "pop", "ac", "an")))
    zero = F.lit(0)
    return per_group.groupBy("key").agg(best.alias("b")).select(
        "key",
        F.coalesce(-c("b.down"), F.lit(0.0)).alias("af"),
        F.coalesce("b.ac", zero).alias("ac"),
        F.coalesce("b.an", zero).alias("an"),
        c("b.pop").alias("pop"),
    )


def homozygotes(callset_rows: DataFrame) -> DataFrame:
    """Homozygote counts of both callsets added per variant."""
    return callset_rows.groupBy("key").agg(F.sum(F.coalesce("homozygote_count", F.lit(0))).alias("hom"))


def group_maximum(sites: DataFrame) -> DataFrame:
    """Group-maximum figures of a site, or its global figures when the group is excluded."""
    usable = (
        c("grpmax").isNotNull() & ~F.lower("grpmax").isin(*POPMAX_EXCLUDED) & c("af_grpmax").isNotNull()
    )
    pick = lambda group, overall: F.when(usable, c(group)).otherwise(c(overall))
    return sites.withColumns(
        {
            "af": pick("af_grpmax", "af"),
            "ac": pick("ac_grpmax", "ac"),
            "an": pick("an_grpmax", "an"),
            "hom": pick("nhomalt_grpmax", "nhomalt"),
            "pop": F.when(usable, c("grpmax")),
        }
    ).where(c("af").isNotNull())


def merged_callsets(exomes: DataFrame, genomes: DataFrame) -> DataFrame:
    """Both callsets as one frame with the callset's name."""
    named = lambda df, name: df.withColumn("callset", F.lit(name))
    return named(exomes, "exomes").unionByName(named(genomes, "genomes"), allowMissingColumns=True)


def covered_contigs(callsets: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Contigs with rows, where both callsets were read completely."""
    present = callsets.groupBy("chrom").agg(F.countDistinct("callset").alias("n"))
    if complete is None:
        return present.where(c("n") == 2).select("chrom")
    both = complete.where("complete").groupBy("chrom").agg(F.countDistinct("callset").alias("n_complete"))
    return present.join(both.where(c("n_complete") == 2), "chrom").select("chrom")


def resolve_callsets(queries: DataFrame, callsets: DataFrame, readable: DataFrame) -> DataFrame:
    """Frequency per queried variant from both callsets.

    The higher frequency wins. No row is an absence (0.0) only where both callsets were
    readable for the contig; otherwise the variant stays unresolved and is left out. A
    zero result next to an unreadable callset is left out as well.
    """
    ranked = F.struct((-F.coalesce("af", F.lit(0.0))).alias("down"), "callset")
    best = callsets.groupBy(*SITE).agg(F.min_by(F.struct("af", "ac", "an", "hom"), ranked).alias("b"))
    read = readable.where("readable").groupBy("chrom").agg(F.countDistinct("callset").alias("n_readable"))
    joined = unique_variants(queries).join(best, SITE, "left").join(read, "chrom", "left")
    both = F.coalesce("n_readable", F.lit(0)) == 2
    empty = (F.coalesce("b.af", F.lit(0.0)) == 0) & (F.coalesce("b.an", F.lit(0)) == 0)
    return joined.where(both | ~empty).select(
        *SITE,
        F.coalesce("b.af", F.lit(0.0)).alias("af"),
        F.coalesce("b.ac", F.lit(0)).alias("ac"),
        F.coalesce("b.an", F.lit(0)).alias("an"),
        c("b").isNull().alias("absent"),
    )


def tolerant_union(frames: list[DataFrame]) -> DataFrame:
    """Union of partitions whose optional columns differ."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


# ---------------------------------------------------------------------------
# Writes
# ---------------------------------------------------------------------------
def write_store(store: DataFrame, path: str, partitions: int | None = None) -> None:
    """Commit one row per locus as the next version of a store; readers see the old one until then."""
    ls.write_version(store, path, buckets=partitions)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return ls.read_version(spark, path).drop(*LOCUS)


def contigs_to_build(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Contigs not yet built under exactly the wanted scope (region, regions file, preset)."""
    same = c("w.chrom") == c("b.chrom")
    for field in ("region", "bed", "preset"):
        same = same & c(f"w.{field}").eqNullSafe(c(f"b.{field}"))
    return wanted.alias("w").join(built.alias("b"), same, "left_anti")


def extend_store(store: DataFrame, path: str, wanted: DataFrame, scopes_path: str | None = None) -> DataFrame:
    """Build only the contigs whose scope changed, as a new version; returns their scopes.

    ``wanted`` has one row per contig. Scopes are kept in the version's manifest;
    ``scopes_path`` also gets them as a table.
    """
    spark = store.sparkSession
    asked = wanted.select("chrom", *ls.SCOPE)
    scopes = {ls.prefixed(r["chrom"]): {k: r[k] for k in ls.SCOPE} for r in asked.collect()}
    due = ls.extend_version(store, path, scopes)
    if scopes_path is not None:
        held = ls.manifest(spark, path)["contigs"]
        rows = [(contig, *(x["scope"][k] for k in ls.SCOPE)) for contig, x in held.items()]
        spark.createDataFrame(rows, asked.schema).coalesce(1).write.mode("overwrite").parquet(scopes_path)
    return asked.where(prefixed_contig(c("chrom")).isin(due))


def coverage_mode(built: DataFrame, requested: DataFrame, region: str | None, bed: str | None) -> DataFrame:
    """One row: coverage mode, covered contigs and rows.

    Full or BED coverage needs all core contigs requested, every requested contig built
    with rows, and no region restriction.
    """
    core = F.array(*[F.lit(x) for x in CORE_CONTIGS])
    asked = requested.agg(F.collect_set(prefixed_contig(c("chrom"))).alias("asked"))
    done = built.where(c("n_rows") > 0).agg(
        F.sort_array(F.collect_set(prefixed_contig(c("chrom")))).alias("contigs"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
    )
    complete = (
        F.lit(region is None)
        & (F.size(F.array_except(core, "asked")) == 0)
        & (F.size(F.array_except("asked", "contigs")) == 0)
    )
    mode = F.when(complete, F.lit("bed" if bed else "full")).otherwise("partial")
    # Both sides are single rows of contig names.
    return done.withColumn("asked", asked.scalar()).select(mode.alias("mode"), "contigs", "rows")


def build_manifest(store: DataFrame, name: str, source: dict, cadence: str, built_at: str | None = None) -> dict:
    """What a store holds and where it comes from, put together as JSON in the aggregation that counts it."""
    update = F.struct(F.lit(cadence).alias("cadence"), F.lit(STALE_AFTER_DAYS.get(name)).cast("int").alias("stale_after_days"))
    built = F.lit(built_at) if built_at else F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    counted = store.agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("chrom")).alias("chroms"))
    described = counted.select(
        F.to_json(
            F.struct(
                F.lit(name).alias("store"), F.lit("parquet").alias("format"), built.alias("built_at"), "rows", "chroms",
                F.array(*[F.lit(f.name.lower()) for f in store.schema]).alias("schema"), update.alias("update"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("text")
    )
    return json.loads(described.first()["text"]) | {"source": source}


def write_sidecar(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON text as a one-file folder, replaced whole."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small sidecar, or None when it is missing."""
    parent, _, name = path.rstrip("/").rpartition("/")
    if not ls.Folder(spark, parent).exists(name):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())

"""Small keyed tables, snapshots and cohort manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.settings import DEFAULTS, Thresholds
from locusflow.sources.lines import tab_fields


def _last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Later lines replace earlier ones."""
    values = [c for c in rows.columns if c not in (key, "file", "line_no")]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*values), "line_no").alias("v"))
        .select(key, *[F.col(f"v.{c}").alias(c) for c in values])
    )


def local_frequencies(lines: DataFrame) -> DataFrame:
    rows = tab_fields(lines, "key", "af", "ac", "an").where(F.col("key") != "")
    return _last_per_key(
        rows.withColumns(
            {
                "af": F.col("af").try_cast("double"),
                "ac": F.coalesce(F.col("ac").try_cast("bigint"), F.lit(0)),
                "an": F.coalesce(F.col("an").try_cast("bigint"), F.lit(0)),
            }
        ),
        "key",
    )


def predictor_scores(lines: DataFrame) -> DataFrame:
    rows = tab_fields(lines, "key", "revel", "cadd").where(F.col("key") != "key")
    return _last_per_key(
        rows.withColumns({c: F.col(c).try_cast("double") for c in ("revel", "cadd")}), "key"
    )


def assertion_slice(lines: DataFrame) -> DataFrame:
    rows = tab_fields(lines, "key", "significance", "review_status", "accession", "condition", "date")
    return _last_per_key(rows.where(F.col("key") != ""), "key")


def gene_list(lines: DataFrame) -> DataFrame:
    return (
        tab_fields(lines, "gene").select(F.upper(F.trim("gene")).alias("gene")).distinct()
    )


def intolerant(pli: Column, loeuf: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.coalesce(pli >= t.pli_intolerant, F.lit(False)) | F.coalesce(
        loeuf < t.loeuf_intolerant, F.lit(False)
    )


def gene_constraint(lines: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    rows = tab_fields(lines, "gene", "pli", "loeuf").where(F.col("gene") != "gene")
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in ("pli", "loeuf")})
    return _last_per_key(rows, "gene").withColumn(
        "lof_intolerant", intolerant(F.col("pli"), F.col("loeuf"), t)
    )


def constraint_release(table: DataFrame, gene="gene", pli="pLI", loeuf="oe_lof_upper", order="line_no") -> DataFrame:
    """Header-indexed release table reduced to the first row of each gene."""
    return (
        table.where(F.col(gene).isNotNull() & (F.col(gene) != ""))
        .groupBy(F.col(gene).alias("gene"))
        .agg(F.min_by(F.struct(F.col(pli).alias("pli"), F.col(loeuf).alias("loeuf")), order).alias("v"))
        .select("gene", F.col("v.pli").try_cast("double").alias("pli"), F.col("v.loeuf").try_cast("double").alias("loeuf"))
    )


def keyed_snapshot(documents: DataFrame, value_schema: str) -> DataFrame:
    """``{key: {...}}`` JSON documents as one row per key."""
    return (
        documents.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("key", "v"))
        .select("key", "v.*")
    )


FREQUENCY_SNAPSHOT = "af double, ac bigint, an bigint, hom bigint, pop string, faf95 double, release string"
MISSENSE_SNAPSHOT = "am_pathogenicity double, am_class string"


def manifest_terms(manifest: DataFrame) -> DataFrame:
    """One row per case and term; a case without terms keeps one row with NULL."""
    terms = F.filter(F.transform(F.split(F.coalesce("hpo", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    others = [c for c in manifest.columns if c != "hpo"]
    return manifest.select(*others, F.explode_outer(terms).alias("term"))


def labelled_panel(lines: DataFrame) -> DataFrame:
    rows = tab_fields(
        lines, "key", "gene", "consequence", "hgvs_p", "clinvar_significance",
        "review_status", "accession", "condition",
    )
    return rows.where(F.col("key") != "")

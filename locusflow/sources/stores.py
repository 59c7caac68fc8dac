"""Raw reference releases as store rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.clinical import known, review_stars
from locusflow.functions.info import info_map
from locusflow.functions.keys import prefixed_contig
from locusflow.functions.consequences import literal_map
from locusflow.settings import NULL_CONSEQUENCES
from locusflow.sources.lines import read_lines, tab_fields
from locusflow.sources.vcf import parse_records

GROUPS = ("afr", "amr", "asj", "eas", "fin", "mid", "nfe", "sas", "ami", "remaining")

# Output column and the INFO key it is read from, for each kind of release file.
PRESETS = {
    "joint": {
        "af": "AF_joint", "af_grpmax": "AF_grpmax_joint", "ac": "AC_joint", "an": "AN_joint",
        "nhomalt": "nhomalt_joint", "faf95": "fafmax_faf95_max_joint", "grpmax_pop": "grpmax_joint",
        **{f"af_{g}": f"AF_joint_{g}" for g in GROUPS},
    },
    "exomes": {
        "af": "AF", "af_grpmax": "AF_grpmax", "ac": "AC", "an": "AN", "nhomalt": "nhomalt",
        "faf95": "fafmax_faf95_max", "grpmax_pop": "grpmax",
        **{f"af_{g}": f"AF_{g}" for g in GROUPS if g != "ami"},
    },
}
TYPES = {"ac": "bigint", "an": "bigint", "nhomalt": "bigint", "grpmax_pop": "string"}


def frequency_sites(lines: DataFrame, preset: str = "joint", pass_only: bool = True) -> DataFrame:
    """Population sites to reduced rows; unparsable or missing values become NULL."""
    records = parse_records(lines)
    if pass_only:
        records = records.where(F.col("filter_status") == "PASS")
    info = F.col("info")
    value = lambda key, column: F.when(
        F.element_at(info, key) != ".", F.element_at(info, key)
    ).try_cast(TYPES.get(column, "double"))
    return records.withColumn("info", info_map(F.col("info_text"))).select(
        prefixed_contig(F.col("chrom")).alias("chrom"),
        "pos",
        "ref",
        F.col("alts").alias("alt"),
        F.col("filter_status").alias("filter"),
        *[value(key, column).alias(column) for column, key in PRESETS[preset].items()],
    )


def assertion_records(lines: DataFrame, condition_chars: int | None = None) -> DataFrame:
    """Clinical-assertion VCF lines with a significance, one row per record.

    The condition is the whole text; ``condition_chars`` cuts it where a caller asks for that.
    """
    field = lambda key: F.translate(
        F.regexp_extract("info_text", f"(?:^|;){key}=([^;]+)", 1), "_", " "
    )
    condition = field("CLNDN")
    if condition_chars is not None:
        condition = F.substring(condition, 1, condition_chars)
    return (
        parse_records(lines)
        .select(
            prefixed_contig(F.col("chrom")).alias("chrom"),
            "pos",
            F.upper("ref").alias("ref"),
            F.upper("alts").alias("alt"),
            field("CLNSIG").alias("significance"),
            field("CLNREVSTAT").alias("review_status"),
            F.coalesce("variant_id", F.lit(".")).alias("accession"),
            condition.alias("condition"),
            "line_no",
        )
        .where((F.col("significance") != "") & (F.col("alt") != "."))
        .withColumn("review_stars", review_stars(F.col("review_status")))
    )


def missense_scores(lines: DataFrame) -> DataFrame:
    """Per-transcript missense scores; comment lines (licence, header) are dropped."""
    rows = tab_fields(
        lines, "chrom", "pos", "ref", "alt", "genome", "uniprot_id", "transcript_id",
        "protein_variant", "am_pathogenicity", "am_class",
    )
    return rows.withColumns(
        {
            "pos": F.col("pos").try_cast("int"),
            "am_pathogenicity": F.col("am_pathogenicity").try_cast("double"),
        }
    )


# Record consequence terms that differ from the names used by the criteria.
RECORD_TERMS = {"nonsense": "stop_gained", "initiator_codon_variant": "start_lost"}


def target_gene_assertions(lines: DataFrame, genes: DataFrame) -> DataFrame:
    """Pathogenic, not conflicting, bi-allelic assertion records of the wanted genes."""
    info = F.col("info")
    terms = F.transform(
        F.filter(F.split(F.element_at(info, "MC"), ","), lambda t: t.contains("|")),
        lambda t: F.substr(t, F.instr(t, "|") + 1),
    )
    names = literal_map(RECORD_TERMS)
    mapped = F.transform(terms, lambda t: F.coalesce(F.element_at(names, t), t))
    null_term = F.get(F.filter(mapped, lambda t: t.isin(*NULL_CONSEQUENCES)), F.lit(0))
    low = F.lower(F.element_at(info, "CLNSIG"))
    return (
        parse_records(lines)
        .where(~F.col("alts").isin(".", "") & ~F.col("alts").contains(",") & (F.col("ref") != "."))
        .withColumn("info", info_map(F.col("info_text")))
        .withColumn("gene", F.substring_index(F.element_at(info, "GENEINFO"), ":", 1))
        .where(known(low.contains("pathogenic") & ~low.contains("conflicting")))
        .join(genes.select("gene").distinct(), "gene", "left_semi")
        .select(
            F.regexp_replace("chrom", "chr", "").alias("chrom"),
            "pos", "ref", F.col("alts").alias("alt"), "gene", "line_no",
            F.element_at(info, "CLNSIG").alias("significance"),
            F.element_at(info, "CLNREVSTAT").alias("review_status"),
            F.coalesce(null_term, F.get(mapped, F.lit(0)), F.lit("missense_variant")).alias("consequence"),
            null_term.isNotNull().alias("is_null_variant"),
        )
    )


def read_frequency_sites(spark: SparkSession, paths, preset: str = "joint") -> DataFrame:
    return frequency_sites(read_lines(spark, paths), preset)


def read_assertions(spark: SparkSession, paths) -> DataFrame:
    return assertion_records(read_lines(spark, paths))


def read_missense_scores(spark: SparkSession, paths) -> DataFrame:
    return missense_scores(read_lines(spark, paths))

"""Text and table outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.binding import let
from locusflow.functions.consequences import literal_map
from locusflow.functions.keys import bare_contig
from locusflow.operators.explore import bucket_memberships, findings_table
from locusflow.operators.routing import not_to_dismiss
from locusflow.settings import GENOTYPE_OF

c = F.col


def general_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, scientific outside 1e-4 to 1e6."""
    return let(F.when(x.isNotNull(), F.format_string("%.5e", x)), lambda scientific: _general(x, scientific))


def _general(x: Column, scientific: Column) -> Column:
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    trimmed = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    fixed = F.when(x == 0, "0")
    for e in range(-4, 6):
        digits = F.format_string(f"%.{5 - e}f", x)
        fixed = fixed.when(exponent == e, F.when(F.contains(digits, F.lit(".")), trimmed(digits)).otherwise(digits))
    mantissa = trimmed(F.substring_index(scientific, "e", 1))
    other = F.concat(mantissa, F.lit("e"), F.regexp_extract(scientific, r"e([+-]\d+)$", 1))
    return F.when(x.isNotNull(), fixed.otherwise(other))


def info_safe(text: Column) -> Column:
    return F.regexp_replace(text, "[ ;=]", "_")


def baked_info(own: str = "info_text") -> Column:
    """INFO text with the annotated values put in front; NULL values are left out."""
    item = lambda key, value: F.concat(F.lit(key + "="), value)
    text = lambda name: F.when(c(name) != "", info_safe(c(name)))
    asserted = F.coalesce(c("clinvar_significance"), F.lit("")) != ""
    with_assertion = lambda key, name: F.when(asserted, item(key, text(name)))
    fields = F.concat_ws(
        ";",
        item("gnomad_AF", general_number(c("gnomad_af"))),
        item("gnomad_AC", c("gnomad_ac").cast("string")),
        item("gnomad_AN", c("gnomad_an").cast("string")),
        item("gnomad_nhomalt", c("gnomad_homozygotes").cast("string")),
        item("gnomad_faf95", general_number(c("gnomad_faf95"))),
        item("CLNSIG", text("clinvar_significance")),
        with_assertion("CLNREVSTAT", "clinvar_review_status"),
        with_assertion("CLNDN", "clinvar_condition"),
        with_assertion("CLNVI", "clinvar_accession"),
        item("am_pathogenicity", general_number(c("am_pathogenicity"))),
    )
    kept = F.when(~F.coalesce(c(own), F.lit("")).isin("", "."), c(own))
    both = F.concat_ws(";", F.when(fields != "", fields), kept)
    return F.when(both == "", ".").otherwise(both)


def annotated_vcf_lines(annotated: DataFrame, own: str = "info_text") -> DataFrame:
    """``sample_id, line_no, value`` lines of an annotated call table."""
    value = F.concat_ws(
        "\t",
        "chrom", c("pos").cast("string"), F.coalesce("variant_id", F.lit(".")), "ref", "alt", F.lit("."),
        F.coalesce("filter_status", F.lit(".")), baked_info(own), F.lit("GT"),
        F.coalesce(F.element_at(literal_map(GENOTYPE_OF), c("zygosity")), F.lit("./.")),
    )
    return annotated.select("sample_id", "line_no", value.alias("value"))


def packet_vcf_lines(variants: DataFrame) -> DataFrame:
    """VCF data lines of case-packet variants; heterozygous when no state is given."""
    safe = lambda name: F.regexp_replace(
        F.regexp_replace(F.when(c(name) != "", c(name)), ";", "|"), "[= \t]", "_"
    )
    info = F.concat_ws(
        ";",
        F.concat(F.lit("GENE="), safe("gene")),
        F.concat(F.lit("HGVSC="), safe("hgvs_c")),
        F.concat(F.lit("HGVSP="), safe("hgvs_p")),
    )
    genotype = F.element_at(literal_map(GENOTYPE_OF), F.coalesce("zygosity", F.lit("het")))
    value = F.concat_ws(
        "\t",
        bare_contig(c("chrom")), c("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("800"), F.lit("PASS"),
        F.when(info == "", ".").otherwise(info), F.lit("GT"), F.coalesce(genotype, F.lit("0/1")),
    )
    return variants.select("subject_id", "variant_no", value.alias("value"))


def vcf_header(sample: Column) -> Column:
    """Header lines of one emitted file as a single text value."""
    columns = F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), sample)
    return F.concat(
        F.lit("##fileformat=VCFv4.2\n##reference=GRCh38\n"),
        F.lit('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n'),
        columns,
    )


def write_lines(lines: DataFrame, path: str, group: str = "sample_id", order: str = "line_no") -> None:
    """One folder per sample; rows are range-partitioned, so a large sample spans many files.

    File names keep the order: within a sample, part numbers follow ``order``.
    """
    headers = lines.select(group).distinct().select(
        group, F.lit(None).cast("bigint").alias(order), vcf_header(c(group)).alias("value")
    )
    rows = headers.unionByName(lines.select(group, c(order).cast("bigint").alias(order), "value"))
    keys = [c(group).asc(), c(order).asc_nulls_first()]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(group, "value").write.partitionBy(group).text(path)


def result_tables(routed: DataFrame, conclusions: DataFrame) -> dict[str, DataFrame]:
    """The persisted result of a run as flat tables that share ``sample_id``."""
    return {
        "findings": findings_table(routed).withColumn("sample_id", c("sample_id")),
        "buckets": routed.select("sample_id", "gene", F.explode(bucket_memberships()).alias("bucket")),
        "conclusions": conclusions,
        "not_to_dismiss": not_to_dismiss(routed),
    }


def write_results(routed: DataFrame, conclusions: DataFrame, path: str, format_: str = "parquet") -> None:
    tables = result_tables(routed, conclusions)
    if "criteria" in routed.columns:
        tables["classifications"] = routed
    for name, table in tables.items():
        table.repartitionByRange("sample_id").write.mode("overwrite").format(format_).save(f"{path}/{name}")


def write_documents(documents: DataFrame, path: str, most_rows: int = 1_000) -> None:
    """One JSON line for each part of a sample's document, in order of samples; files hold ``most_rows`` lines at most."""
    ordered = documents.repartitionByRange("sample_id", "part").sortWithinPartitions("sample_id", "part")
    ordered.write.option("maxRecordsPerFile", most_rows).option("ignoreNullFields", False).json(path)


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)

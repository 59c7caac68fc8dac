"""Carrier rows of joint or single-sample call sets restricted to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.info import allele_element, info_value, stated_info
from locusflow.functions.keys import reportable_allele
from locusflow.operators.intervals import restrict_wide_rows
from locusflow.operators.quality import passes_filter
from locusflow.operators.skew import attach
from locusflow.sources.vcf import file_headers, parse_records

c = F.col


def _records(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Records inside the regions with the names of their file's samples; no text is moved for either."""
    inside = restrict_wide_rows(parse_records(lines), regions, ["file", "line_no"])
    return attach(inside, file_headers(lines).select("file", "sample_names"), ["file"], ["line_no"])


def _alleles(records: DataFrame) -> DataFrame:
    """One row per record and reportable ALT, numbered from 1 as ``allele_no``."""
    each = records.select("*", F.posexplode(F.split("alts", ",")).alias("_at", "alt")).where(reportable_allele(c("alt")))
    return each.withColumn("allele_no", c("_at") + 1)


def _carrier_rows(alleles: DataFrame) -> DataFrame:
    """One row per carrier and ALT, with a bi-allelic genotype and depths; ``info_text`` is the ALT's.

    Steps are plain columns, since functions over arrays with a body are not compiled. A
    sample field that carries nothing ends at the filter.
    """
    kept = ("file", "line_no", "sample_names", "chrom", "pos", "ref", "alt", "allele_no", "info_text")
    fields = ("GT", "AD", "DP", "GQ")
    places = {f"_{f}": F.array_position(F.split("format", ":"), F.lit(f)).cast("int") for f in fields}
    samples = alleles.withColumns(places).select(*kept, *places, F.posexplode("sample_fields").alias("_sample", "_text"))
    own = lambda f: F.when(c(f"_{f}") > 0, F.get("_values", c(f"_{f}") - 1))
    carried = (
        samples.withColumn("_values", F.split("_text", ":"))
        .withColumn("_alleles", F.split(F.translate(own("GT"), "|", "/"), "/"))
        .where(F.array_contains(c("_alleles").try_cast("array<int>"), c("allele_no")))
        .withColumn("_depths", F.split(own("AD"), ","))
    )
    copies = F.size("_alleles") - F.size(F.array_remove("_alleles", c("allele_no").cast("string")))
    pair = F.concat_ws(",", F.get("_depths", F.lit(0)), F.get("_depths", c("allele_no")))
    value = F.concat_ws(
        ":", F.when(copies == 2, "1/1").otherwise("0/1"), F.coalesce(own("DP"), F.lit(".")), F.coalesce(own("GQ"), F.lit(".")),
        F.when(F.size("_depths") > c("allele_no"), pair).otherwise("."),
    )
    return carried.select(
        "file", "line_no", F.get("sample_names", c("_sample")).alias("sample_id"), "chrom", "pos", "ref", "alt", "info_text",
        value.alias("sample_value"),
    )


_COUNTS = ("AC", "AN", "nhomalt")


def _with_allele_info(records: DataFrame, vep_fields: list[str]) -> DataFrame:
    """One row per record and ALT whose ``info_text`` is the ALT's own."""
    parsed = ("AF", *_COUNTS, "gnomad_AF_popmax", *[f"gnomad_{n}_popmax" for n in _COUNTS], "gnomad_popmax", "vep")
    lists = {f"_{key}": F.split(info_value("_info", key), ",") for key in parsed}
    at, number = c("allele_no") - 1, c("allele_no").cast("string")
    value = lambda key: allele_element(c(f"_{key}"), at)
    usable = lambda x: F.when((x != ".") & (x != ""), x)
    own = c("_group_af").isNull()
    text = lambda name: F.coalesce(usable(c(name)), F.lit("."))
    number_at = vep_fields.index("ALLELE_NUM")
    before = lambda e: F.substring_index(e, "|", number_at) if number_at else F.lit("")
    bar = "|" if number_at else ""

    def renumbered(e: Column) -> Column:
        rest = F.length(before(e)) + len(bar) + F.length(number) + 1
        return F.concat(before(e), F.lit(f"{bar}1"), F.substr(e, rest))

    mine = F.filter("_vep", lambda e: F.get(F.split(e, r"\|"), F.lit(number_at)) == number)
    return (
        _alleles(records.withColumn("_info", stated_info(c("info_text"), parsed)).withColumns(lists).drop("_info"))
        .withColumn("_csq", F.array_join(F.transform(mine, renumbered), ","))
        .withColumn("_group_af", usable(value("gnomad_AF_popmax")))
        .withColumns(
            {f"_own_{n}": F.when(own, value(n)).otherwise(value(f"gnomad_{n}_popmax")) for n in _COUNTS}
            | {"_own_AF": F.when(own, value("AF")).otherwise(c("_group_af")), "_popmax": value("gnomad_popmax")}
        )
        .withColumn(
            "info_text",
            F.concat_ws(
                ";",
                F.concat(F.lit("gnomad_AF="), text("_own_AF")),
                *[F.concat(F.lit(f"gnomad_{n}="), text(f"_own_{n}")) for n in _COUNTS],
                F.concat(F.lit("gnomad_popmax="), F.when(own, "hgdp_tgp").otherwise(text("_popmax"))),
                F.when(c("_csq") != "", F.concat(F.lit("CSQ="), "_csq")),
            ),
        )
    )


def joint_carriers(lines: DataFrame, regions: DataFrame, vep_fields: list[str]) -> DataFrame:
    """Carrier rows of every sample of a joint file.

    Frequencies are the group-maximum ones, or the call set's own where those are missing;
    consequence entries are kept for the carried allele and renumbered to 1. INFO is
    parsed once a record and written once an ALT, before samples become rows.
    """
    return _carrier_rows(_with_allele_info(_records(lines, regions), vep_fields))


def passing_carriers(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Carrier rows of PASS records, re-emitted bi-allelic without INFO."""
    records = _records(lines, regions).where(passes_filter(c("filter_status")))
    return _carrier_rows(_alleles(records).withColumn("info_text", F.lit(".")))

"""VCF text to one row per (record, ALT allele, sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.consequences import FIELDS, effect_of
from locusflow.functions.binding import let
from locusflow.functions.info import info_map
from locusflow.functions.keys import reportable_allele, zygosity
from locusflow.operators.skew import attach
from locusflow.sources.lines import read_lines

CALL_COLUMNS = [
    "file", "line_no", "sample_id", "chrom", "pos", "ref", "alt", *FIELDS,
    "zygosity", "depth", "gq", "allele_balance", "filter_status", "variant_id",
    "n_alts", "alt_index", "info",
]

BUILD_TOKENS = {"GRCh38": ("grch38", "hg38"), "GRCh37": ("grch37", "hg19", "b37", "g1k_v37")}


def read_vcf(
    spark: SparkSession, paths, sample: str | None = None, all_samples: bool = False, carriers_only: bool = False
) -> DataFrame:
    return parse_calls(read_lines(spark, paths), sample, all_samples, carriers_only)


def file_headers(lines: DataFrame) -> DataFrame:
    """One row per file: declared build, CSQ field order and sample names."""
    header = lines.where(F.col("value").startswith("#"))
    low = F.lower("value")
    names = lambda build: F.max(
        F.when(
            F.greatest(*[low.contains(token).cast("int") for token in BUILD_TOKENS[build]]) == 1,
            F.lit(True),
        )
    )
    format_line = F.col("value").startswith("##INFO=<ID=CSQ") & F.col("value").contains("Format:")
    columns_line = F.col("value").startswith("#CHROM")
    first = lambda test: F.min_by(F.when(test, F.col("value")), F.when(test, F.col("line_no")))
    per_file = header.groupBy("file").agg(
        names("GRCh38").alias("is38"),
        names("GRCh37").alias("is37"),
        first(format_line).alias("format_line"),
        first(columns_line).alias("columns_line"),
    )
    layout = F.get(F.split("format_line", "Format:"), F.lit(1))
    layout = F.trim(F.regexp_replace(F.trim(layout), '[">]+$', ""))
    columns = F.split("columns_line", "\t")
    return per_file.select(
        "file",
        F.when(F.col("is38"), "GRCh38").when(F.col("is37"), "GRCh37").alias("build"),
        F.transform(F.split(layout, "[|]"), lambda x: F.trim(x)).alias("csq_fields"),
        F.when(F.size(columns) > 9, F.slice(columns, 10, F.size(columns) - 9))
        .otherwise(F.array().cast("array<string>"))
        .alias("sample_names"),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Well-formed data lines as fixed columns plus FORMAT and the array of sample fields."""
    c = F.split("value", "\t")
    return (
        lines.where(~F.col("value").startswith("#"))
        .select("file", "line_no", c.alias("c"))
        .where(
            (F.size("c") >= 8)
            & F.col("c")[1].rlike("^[0-9]+$")
            & (F.col("c")[3] != "")
            & (F.col("c")[4] != "")
        )
        .select(
            "file",
            "line_no",
            F.col("c")[0].alias("chrom"),
            F.col("c")[1].try_cast("int").alias("pos"),
            F.when(~F.col("c")[2].isin("", "."), F.col("c")[2]).alias("variant_id"),
            F.col("c")[3].alias("ref"),
            F.col("c")[4].alias("alts"),
            F.col("c")[6].alias("filter_status"),
            F.col("c")[7].alias("info_text"),
            F.get("c", F.lit(8)).alias("format"),
            F.when(F.size("c") > 9, F.slice("c", 10, F.size("c") - 9))
            .otherwise(F.array().cast("array<string>"))
            .alias("sample_fields"),
        )
    )


def _measures(f: Column, alt_index: Column) -> Column:
    """Depth, genotype quality and share of the ALT's reads from the texts DP, GQ and AD."""

    def depths(text: Column) -> Column:
        parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
        return let(parts, lambda p: F.when(text.contains(",") & ~F.exists(p, lambda x: x.isNull()), p))

    def measures(counts: Column, total: Column) -> Column:
        covered = (total > 0) & (F.size(counts) > alt_index + 1)
        stated = F.when(f["DP"].rlike("^[0-9]+$"), f["DP"].try_cast("int"))
        return F.struct(
            F.coalesce(stated, F.when(total > 0, total)).alias("depth"),
            F.when(~f["GQ"].isin(".", "-1"), F.trim(f["GQ"]).try_cast("double").try_cast("int")).alias("gq"),
            F.when(covered, F.round(F.get(counts, alt_index + 1) / total, 3)).alias("allele_balance"),
        )

    summed = lambda counts: F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return let(depths(f["AD"]), lambda counts: let(summed(counts), lambda total: measures(counts, total)))


def sample_metrics(format_: Column, sample: Column, alt_index: Column) -> Column:
    """Genotype fields of one sample for one ALT; pairing stops at the shorter list."""
    names, values = F.split(format_, ":"), F.split(sample, ":")
    usable = (F.coalesce(format_, F.lit("")) != "") & (F.coalesce(sample, F.lit("")) != "")

    def fields(both: Column) -> Column:
        shared = F.least(F.size(both["names"]), F.size(both["values"]))
        paired = F.reverse(F.slice(both["names"], F.lit(1), shared))

        def value(name: str) -> Column:
            return let(
                F.array_position(paired, F.lit(name)).cast("int"),
                lambda from_end: F.when(from_end > 0, F.get(both["values"], shared - from_end)),
            )

        return F.struct(*[value(n).alias(n) for n in ("GT", "DP", "GQ", "AD")])

    both = F.when(usable, F.struct(names.alias("names"), values.alias("values")))
    measured = lambda f, m: F.struct(
        zygosity(f["GT"], alt_index + 1).alias("zygosity"), *[m[x].alias(x) for x in ("depth", "gq", "allele_balance")]
    )
    return let(let(both, fields), lambda f: let(_measures(f, alt_index), lambda m: measured(f, m)))


def _last_place(name: str) -> Column:
    """For every number of leading FORMAT names, from 0, the place of the last ``name`` among them (from 1, else 0)."""
    names = F.col("_names")
    until = lambda n: F.array_position(F.reverse(F.slice(names, F.lit(1), n)), F.lit(name)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: let(until(n), lambda p: F.when(p > 0, n + 1 - p).otherwise(0)))


def _sample_rows(alleles: DataFrame, carriers_only: bool) -> DataFrame:
    """One row per allele and sample with what ``sample_metrics`` says of it.

    FORMAT is read once an allele and genotypes in plain columns, since functions over arrays
    with a body are not compiled; a field that carries nothing ends at the filter.
    """
    # A record may end before its sample columns; every named sample still gets its row.
    columns = F.when(F.size("sample_names") > 0, F.col("sample_names")).otherwise(F.col("sample_fields"))
    places = {f"_{f}": _last_place(f) for f in ("GT", "DP", "GQ", "AD")}
    each = F.posexplode(columns) if carriers_only else F.posexplode_outer(columns)
    rows = alleles.withColumn("_names", F.split("format", ":")).withColumns(places).select("*", each.alias("sample_at", "_named"))
    values = F.split(F.get("sample_fields", F.col("sample_at")), ":")
    own = lambda f: F.get("_values", F.get(f"_{f}", F.least(F.size("_values"), F.size("_names"))) - 1)
    wanted, missing = (F.col("alt_index") + 1).cast("string"), F.array(F.lit("."), F.lit("-1"))
    rows = rows.withColumn("_values", values).withColumn("_alleles", F.split(F.translate(own("GT"), "|", "/"), "/"))
    carried = F.array_contains("_alleles", wanted)
    usable = carried & ~F.arrays_overlap("_alleles", missing)
    if carriers_only:
        rows = rows.where(usable)
    copies = F.size("_alleles") - F.size(F.array_remove("_alleles", wanted))
    state = F.when(F.size("_alleles") == 1, "hemi").when(copies == F.size("_alleles"), "hom").otherwise("het")
    fields = F.struct(*[own(f).alias(f) for f in ("DP", "GQ", "AD")])
    return rows.withColumns({"zygosity": F.when(usable, state), "metrics": let(fields, lambda f: _measures(f, F.col("alt_index")))})


def _proband(sample: str | None) -> Column:
    if sample is None:
        return F.lit(0)
    at = F.array_position("sample_names", F.lit(sample)).cast("int")
    missing = F.concat(F.lit(f"sample {sample} is not a column of "), F.col("file"))
    return F.when(at > 0, at - 1).otherwise(F.raise_error(missing).cast("int"))


def _proband_rows(alleles: DataFrame, sample: str | None) -> DataFrame:
    """Every allele with what ``sample_metrics`` says of its file's one sample, in plain, compiled columns.

    Only counts of reads other than two or three short whole numbers are read by functions with a body.
    """
    names, values, paired = F.col("_names"), F.col("_values"), F.col("_paired")
    field = F.get("sample_fields", F.col("sample_at"))
    usable = (F.coalesce("format", F.lit("")) != "") & (F.coalesce(field, F.lit("")) != "")
    rows = alleles.withColumn("sample_at", _proband(sample)).withColumns(
        {"_names": F.split("format", ":"), "_values": F.when(usable, F.split(field, ":"))}
    )
    rows = rows.withColumn("_paired", F.reverse(F.slice(names, F.lit(1), F.least(F.size(names), F.size(values)))))
    place = lambda name: F.array_position(paired, F.lit(name)).cast("int")
    own = {f"_{n}": F.when(place(n) > 0, F.get(values, F.size(paired) - place(n))) for n in ("GT", "DP", "GQ", "AD")}
    gt, dp, gq, ad = (F.col(n) for n in own)
    rows = rows.withColumns(own).withColumns({"_alleles": F.split(F.translate(gt, "|", "/"), "/"), "_counts": F.split(ad, ",")})
    alleles_, wanted = F.col("_alleles"), (F.col("alt_index") + 1).cast("string")
    carried = F.array_contains(alleles_, wanted) & ~F.arrays_overlap(alleles_, F.array(F.lit("."), F.lit("-1")))
    copies = F.size(alleles_) - F.size(F.array_remove(alleles_, wanted))
    state = F.when(F.size(alleles_) == 1, "hemi").when(copies == F.size(alleles_), "hom").otherwise("het")
    simple = F.coalesce(ad.rlike("^[0-9]{1,8},[0-9]{1,8}(,[0-9]{1,8})?$"), F.lit(False))
    count = lambda at: F.get("_counts", at).try_cast("int")
    fields = F.struct(dp.alias("DP"), gq.alias("GQ"), ad.alias("AD"))
    rows = rows.withColumns(
        {
            "_total": F.when(simple, count(F.lit(0)) + count(F.lit(1)) + F.coalesce(count(F.lit(2)), F.lit(0))),
            "_other": F.when(ad.contains(",") & ~simple, let(fields, lambda f: _measures(f, F.col("alt_index")))),
        }
    )
    total = F.when(F.col("_total") > 0, F.col("_total"))
    stated = F.when(dp.rlike("^[0-9]+$"), dp.try_cast("int"))
    metrics = F.struct(
        F.coalesce(stated, total, F.col("_other.depth")).alias("depth"),
        F.when(~gq.isin(".", "-1"), F.trim(gq).try_cast("double").try_cast("int")).alias("gq"),
        F.coalesce(F.round(count(F.col("alt_index") + 1) / total, 3), F.col("_other.allele_balance")).alias("allele_balance"),
    )
    return rows.withColumns({"zygosity": F.when(carried, state), "metrics": metrics})


def with_header(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Records with what their file's header says; the header table goes to the records, not the text to it."""
    return attach(records, file_headers(lines), ["file"], ["line_no"])


def parse_calls(
    lines: DataFrame, sample: str | None = None, all_samples: bool = False, carriers_only: bool = False
) -> DataFrame:
    """Split multi-allelic records and pair every reported allele with its sample(s).

    One sample per file by default (the named column, else the first); with
    ``all_samples`` every sample column of a joint file becomes a row, or only those that
    carry the allele with ``carriers_only``. Everything that belongs to the allele is
    parsed once; samples are chosen in the record's array and become rows last.
    """
    alleles = (
        with_header(parse_records(lines), lines)
        .withColumn("n_alts", F.size(F.split("alts", ",")))
        .select("*", F.posexplode(F.split("alts", ",")).alias("alt_index", "alt"))
        .where(reportable_allele(F.col("alt")))
        .withColumn("info", info_map(F.col("info_text")))
        .withColumn(
            "effect",
            effect_of(
                F.col("info"), F.col("csq_fields"), F.col("ref"), F.col("alt"),
                F.col("alt_index"), F.col("n_alts"),
            ),
        )
    )
    if all_samples:
        rows = _sample_rows(alleles, carriers_only)
    else:
        rows = _proband_rows(alleles, sample)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.vcf(\.b?gz)?$", "")
    return rows.select(
        "file",
        "line_no",
        F.coalesce(F.get("sample_names", F.col("sample_at")), stem).alias("sample_id"),
        "chrom", "pos", "ref", "alt",
        *[F.col(f"effect.{f}").alias(f) for f in FIELDS],
        "zygosity", "metrics.depth", "metrics.gq", "metrics.allele_balance",
        "filter_status", "variant_id", "n_alts", "alt_index", "info", "build",
    )

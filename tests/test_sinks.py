"""Written outputs read back."""

from pyspark.sql import functions as F

from locusflow.operators.sinks import annotated_vcf_lines, general_number, write_lines, write_tsv
from locusflow.sources.vcf import read_vcf


def test_general_number(spark):
    values = [0.0, 1.0, 0.25, 1e-05, 0.000123456789, 123456.7, 1234567.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["t"] for r in df.select("x", general_number(F.col("x")).alias("t")).collect()]
    assert got == [None if v is None else "%g" % v for v in values]


def test_vcf_lines_read_back(spark, tmp_path):
    calls = spark.createDataFrame(
        [("s1", n, "chr1", 100 + n, "A", "C", "PASS", "het", 0.001, "Likely pathogenic") for n in range(50)]
        + [("s2", 1, "chr2", 7, "G", "T", "PASS", "hom", None, None)],
        "sample_id string, line_no long, chrom string, pos int, ref string, alt string, filter_status string, zygosity string, gnomad_af double, clinvar_significance string",
    )
    empty = {c: F.lit(None).cast("string") for c in ("variant_id", "clinvar_review_status", "clinvar_condition", "clinvar_accession", "info_text")}
    numbers = {c: F.lit(None).cast("double") for c in ("gnomad_ac", "gnomad_an", "gnomad_homozygotes", "gnomad_faf95", "am_pathogenicity")}
    path = str(tmp_path / "out")
    write_lines(annotated_vcf_lines(calls.withColumns({**empty, **numbers})), path)
    parsed = read_vcf(spark, f"{path}/sample_id=s1")
    assert parsed.count() == 50
    row = parsed.where("pos = 100").first()
    assert (row["zygosity"], row["info"]) == ("het", {"gnomad_AF": "0.001", "CLNSIG": "Likely_pathogenic"})
    write_tsv(calls.select("sample_id", "pos"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 51

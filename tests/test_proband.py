"""Genotype fields of a file's one sample are read in compiled columns and say what ``sample_metrics`` says."""

from pyspark.sql import functions as F

from locusflow.sources.vcf import parse_calls, sample_metrics

FORMATS = ["GT:DP:GQ:AD", "GT:AD", "DP:GT", "GT:GT:DP", "GT", "AD:DP:GQ", "", None]
SAMPLES = [
    "0/1:30:99:10,20", "1|1:.:40.0:0,7", "1:5:-1:3,4,9", "./.:.:.:.", "0/2:12:x:1,2,3", "2/1:8:50:1, 2", "1/.:3:2:4,5", "-1/1:1:1:1,1", "0/1",
    "1/1:+5:7:1,2,3,4,5", "0/1:10:20:123456789,1", "1/2:10:20:a,1", "0/1:10:20:,", "0|1:10: 9 :5", "2:3:4:0,0", "0/1:9,9:1:2,3", "", ".",
]


def test_proband_fields_equal_the_plain_expression(spark):
    header = [("f.vcf", -1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS")]
    given = [(n, f, s) for n, (f, s) in enumerate((f, s) for f in FORMATS for s in SAMPLES)]
    record = lambda n, f, s: "\t".join(["1", str(n + 1), ".", "A", "C,G", ".", "PASS", "DB", *([] if f is None else [f, s])])
    lines = spark.createDataFrame(header + [("f.vcf", n, record(n, f, s)) for n, f, s in given], "file string, line_no long, value string")
    fields = ["zygosity", "depth", "gq", "allele_balance"]
    parsed = parse_calls(lines)
    got = {(r["line_no"], r["alt_index"]): tuple(r[x] for x in fields) for r in parsed.collect()}
    asked = spark.createDataFrame([(n, a, f, s if f is not None else None) for n, f, s in given for a in (0, 1)], "n long, a int, f string, s string")
    plain = asked.select("n", "a", sample_metrics(F.col("f"), F.col("s"), F.col("a")).alias("m")).collect()
    want = {(r["n"], r["a"]): tuple(r["m"][x] for x in fields) for r in plain}
    assert len(got) == 2 * len(given) and got == want
    assert {x[0] for x in got.values()} == {None, "het", "hom", "hemi"}
    # Functions over arrays with a body are not compiled.
    assert "lambda" not in parsed.select("zygosity", "gq")._jdf.queryExecution().optimizedPlan().toString()

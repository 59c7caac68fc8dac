"""Joint call sets: what samples carry, and INFO of one ALT, from hand-written lines."""

from pyspark.sql import functions as F

from locusflow.functions.info import info_map, info_value, stated_info
from locusflow.sources.joint import joint_carriers, passing_carriers
from locusflow.sources.vcf import parse_calls, sample_metrics

FIELDS = ["Allele", "SYMBOL", "ALLELE_NUM", "x"]
HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC"
INFO = "AF=0.5,.;AC=1,2;gnomad_AC_popmax=3;AC;gnomad_AF_popmax=.,0.1;vep=C|G|1|a,T|H|2|b,T|I|2|;AN=7"
BODY = [
    f"chr1\t100\t.\tA\tC,T,<DEL>\t.\tPASS\t{INFO}\tGT:AD:DP:GQ\t1|2:4,5,6,0:15:9\t0/0:9\t3/2:1",
    "chr1\t101\t.\tA\tG\t.\tPASS\t.\tGT:GT:DP\t0/1\t0/1:0/0:3\t.:1/1:.",
    "chr1\t102\t.\tA\tG\t.\tq10\t.\tDP\t0/1\t1\t1/1", "chr1\t103\t.\tA\tG\t.\t.\t.\tGT\t./1\t1\t01", "chr1\t500\t.\tA\tG\t.\tPASS\t.\tGT\t1\t1\t1",
    "chr1\t104\t.\tA\tG\t.\tPASS\t.",
]


def joint(spark):
    lines = spark.createDataFrame([("f", n, v) for n, v in enumerate([HEAD, *BODY])], "file string, line_no bigint, value string")
    return lines, spark.createDataFrame([("chr1", 0, 200)], "chrom string, start bigint, end bigint")


def compiled(df) -> bool:
    """Whether no step over sample fields is left to functions over arrays with a body."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "lambda" not in plan.split("posexplode(sample_fields")[0] and "posexplode(sample_fields" in plan


def test_carriers_of_a_joint_file(spark):
    lines, regions = joint(spark)
    found = joint_carriers(lines, regions, FIELDS)
    rows = {(r["pos"], r["sample_id"], r["alt"]): (r["sample_value"], r["info_text"]) for r in found.collect()}
    first = "gnomad_AF=0.5;gnomad_AC=true;gnomad_AN=7;gnomad_nhomalt=.;gnomad_popmax=hgdp_tgp;CSQ=C|G|1|a"
    other = "gnomad_AF=0.1;gnomad_AC=3;gnomad_AN=.;gnomad_nhomalt=.;gnomad_popmax=.;CSQ=T|H|1|b,T|I|1|"
    assert rows[100, "A", "C"] == ("0/1:15:9:4,5", first) and rows[100, "A", "T"] == ("0/1:15:9:4,6", other)
    assert rows[100, "C", "T"] == ("0/1:.:.:.", other) and rows[103, "C", "G"][0] == "0/1:.:.:."
    assert set(rows) == {(100, "A", "C"), (100, "A", "T"), (100, "C", "T"), (101, "A", "G"), (101, "B", "G"), (103, "A", "G"), (103, "B", "G"), (103, "C", "G")}
    passing = passing_carriers(lines, regions)
    assert {(r["pos"], r["sample_id"], r["alt"]) for r in passing.collect()} == set(rows)
    assert compiled(passing.select("sample_id", "sample_value"))


def test_samples_as_rows_agree_with_their_metrics(spark):
    lines, _ = joint(spark)
    rows = parse_calls(lines, all_samples=True)
    texts = {(p[1], s): (p[8] if len(p) > 8 else None, p[9 + i] if len(p) > 9 else None) for p in (b.split("\t") for b in BODY) for i, s in enumerate("ABC")}
    got = {(r["pos"], r["sample_id"], r["alt_index"]): (r["zygosity"], r["depth"], r["gq"], r["allele_balance"]) for r in rows.collect()}
    given = [(int(p), s, a, *texts[str(p), s]) for p, s, a in got]
    asked = spark.createDataFrame(given, "pos int, s string, a int, f string, t string").select("pos", "s", "a", sample_metrics(F.col("f"), F.col("t"), F.col("a")).alias("m"))
    assert got == {(r["pos"], r["s"], r["a"]): tuple(r["m"]) for r in asked.collect()} and len(got) == 21
    carried = parse_calls(lines, all_samples=True, carriers_only=True).collect()
    assert {(r["pos"], r["sample_id"], r["alt_index"]) for r in carried} == {k for k, v in got.items() if v[0]}


def test_info_value_agrees_with_the_map(spark):
    texts = ["K=1;K;K", "K;K=2", "K;K;K", "AK=1;KA=2", ".", "", "K=", "x;K=a=b;KK", None]
    both = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", stated_info(F.col("t"), ["K", "x"]))
    for r in both.select(info_value("s", "K").alias("a"), F.element_at(info_map(F.col("t")), "K").alias("b")).collect():
        assert (r["a"] or None) == (r["b"] or None)

"""VCF edge cases and annotation picks from hand-written lines."""

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusflow.functions import consequences as cq
from locusflow.functions.info import carried_annotation, info_map
from locusflow.functions.keys import contig_list, minimal_allele, variant_key, zygosity
from locusflow.sources.lines import read_lines
from locusflow.sources.ontology import parse_obo
from locusflow.sources.vcf import file_headers, parse_calls, read_vcf

HEAD = ["##fileformat=VCFv4.2", "##reference=hg38", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
BODY = [
    "chr1\t100\trs1\tA\tC,<DEL>,T\t.\tPASS\tGENE=G1;CSQ=missense_variant\tGT:AD:GQ\t1/3:5,10,0,5:30.7\t0/0:20,0,0,0:9",
    "1\t200\t.\ta\tg\t.\tq10\tDB\tGT:DP\t1\t./.",
    "chr1\tx\t.\tA\tC\t.\tPASS\t.", "chr1\t5\t.", "chr1\t7\t.\tA\t\t.\tPASS\t.",
    "chr1\t300\t.\tA\t*\t.\tPASS\t.\tGT\t1/1\t0/1",
    "chr1\t400\t.\tA\tG\t.\tPASS\tA=1;A=2;F;E=x=y",
]


def write(path, lines, end="\n"):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", newline="") as out:
        out.write(end.join(lines) + end)
    return str(path)


@pytest.mark.parametrize("name,end", [("s.vcf", "\n"), ("s.vcf.gz", "\n"), ("crlf.vcf", "\r\n")])
def test_vcf_records(spark, tmp_path, name, end):
    calls = read_vcf(spark, write(tmp_path / name, HEAD + BODY, end))
    got = {(r["pos"], r["alt"]): r for r in calls.collect()}
    assert set(got) == {(100, "C"), (100, "T"), (200, "g"), (400, "G")}
    c, t = got[100, "C"], got[100, "T"]
    assert (c["zygosity"], c["depth"], c["gq"], c["allele_balance"], c["n_alts"], c["alt_index"]) == ("het", 20, 30, 0.5, 3, 0)
    assert (t["zygosity"], t["allele_balance"], t["alt_index"], t["sample_id"]) == ("het", 0.25, 2, "A")
    assert got[200, "g"]["zygosity"] == "hemi" and got[400, "G"]["zygosity"] is None
    assert got[400, "G"]["info"] == {"A": "2", "F": "true", "E": "x=y"}


def test_samples_and_order(spark, tmp_path):
    path = write(tmp_path / "two.vcf", HEAD + BODY)
    lines = read_lines(spark, path)
    assert [r["value"][:5] for r in lines.orderBy("line_no").collect()] == [x[:5] for x in HEAD + BODY]
    head = file_headers(lines).first()
    assert head["build"] == "GRCh38" and head["sample_names"] == ["A", "B"]
    assert {r["sample_id"] for r in parse_calls(lines, all_samples=True).collect()} == {"A", "B"}
    assert parse_calls(lines, sample="B").where("pos = 100").first()["zygosity"] is None
    with pytest.raises(PySparkException):
        parse_calls(lines, sample="C").collect()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("gt,n,want", [("0/1", 1, "het"), ("1|1", 1, "hom"), ("1/2", 2, "het"), ("0/0", 1, None), ("./1", 1, None), ("1", 1, "hemi"), (".", 1, None), ("2/2", 1, None)])
def test_zygosity(spark, gt, n, want):
    assert one(spark, zygosity(F.lit(gt), F.lit(n))) == want


@pytest.mark.parametrize("ref,alt,want", [("A", "C", "C"), ("CAT", "C", "-"), ("C", "CAT", "AT"), ("AC", "AG", "G")])
def test_minimal_allele(spark, ref, alt, want):
    assert one(spark, minimal_allele(F.lit(ref), F.lit(alt))) == want


def test_annotation_picks(spark):
    other = "T|stop_lost|H|X|i|t|T|b|1/2|c.1|p.1"
    pick = lambda n: one(spark, cq.pick_ann(F.lit(other), F.lit("A"), F.lit("C"), F.lit(n)))
    assert pick(2) is None and pick(1)["gene"] == "X"
    assert one(spark, cq.legacy_protein_change(F.lit("Q59*"))) == "p.Gln59Ter"
    fields = F.array(*[F.lit(x) for x in ("Allele", "Consequence", "SYMBOL", "HGVSc")])
    got = one(spark, cq.pick_csq(F.lit("C|missense_variant&x|G|c.100+1G%3EA,C|y|H|%zz"), fields, F.lit("A"), F.lit("C"), F.lit(0), F.lit(1)))
    assert (got["gene"], got["consequence"], got["hgvs_c"]) == ("G", "missense_variant", "c.100+1G>A")
    assert one(spark, cq.percent_decoded(F.lit("a%zz"))) == "a%zz"


def test_presence_beats_value(spark):
    got = one(spark, carried_annotation(info_map(F.lit("gnomad_AF=.,0.1;CADD_PHRED=.")), F.lit(0)))
    assert got["has_gnomad"] and got["gnomad_af"] is None and not got["has_insilico"]
    assert not one(spark, carried_annotation(info_map(F.lit("gnomad_AF=.")), F.lit(0)))["has_gnomad"]


def test_small_helpers(spark):
    assert contig_list("1-3, X,Y") == ["1", "2", "3", "X", "Y"]
    row = spark.createDataFrame([("CHR1", 5, "a", "t")], "chrom string, pos int, ref string, alt string")
    assert row.select(variant_key().alias("k")).first()["k"] == "1-5-A-T"
    text = "[Term]\nid: HP:1\nname: one\nis_a: HP:0 ! root\n\n[Term]\nid: HP:2\nis_obsolete: true\n\n[Typedef]\nid: HP:3"
    stanzas = spark.createDataFrame([(x,) for x in text.split("\n\n")], "value string")
    assert [(r["term"], r["parents"]) for r in parse_obo(stanzas).collect()] == [("HP:1", ["HP:0"])]

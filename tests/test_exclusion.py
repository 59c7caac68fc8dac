"""Cases excluded by coordinate whatever the contig spelling, and whole condition texts."""

from locusflow.operators.evaluation import unused_cases
from locusflow.sources.stores import assertion_records


def test_used_coordinates_match_across_contig_spellings(spark):
    columns = "gene string, chrom string, pos long, ref string, alt string"
    cases = spark.createDataFrame([("A", "1", 10, "g", "T"), ("B", "chr2", 20, "C", "T"), ("C", "3", 30, "C", "T"), ("d", "4", 40, "C", "T")], columns)
    used = spark.createDataFrame([("X", "chr1", 10, "G", "T"), ("Y", "2", 20, "C", "t"), ("D", "9", 9, "C", "T")], columns)
    assert [r["gene"] for r in unused_cases(cases, used).collect()] == ["C"]


def test_condition_text_is_whole(spark):
    name = "_".join(["condition"] * 40)
    line = f"1\t10\t77\tA\tC\t.\t.\tCLNSIG=Pathogenic;CLNREVSTAT=practice_guideline;CLNDN={name}"
    lines = spark.createDataFrame([("f", 0, line)], "file string, line_no long, value string")
    whole, = assertion_records(lines).collect()
    assert whole["condition"] == name.replace("_", " ")
    cut, = assertion_records(lines, condition_chars=120).collect()
    assert cut["condition"] == name.replace("_", " ")[:120]

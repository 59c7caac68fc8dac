"""Splitting block-compressed gzip text."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locusflow.sources.block_gzip import compress, member, member_size, range_lines, read_block_gzip, write_block_gzip
from locusflow.sources.lines import read_lines
from locusflow.sources.vcf import parse_calls, read_vcf


def text_of(rng, n):
    lines = ["".join(rng.choice("abé\t") for _ in range(rng.choice([0, 1, 7, 40, 300]))) for _ in range(n)]
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_every_line_once(tmp_path, seed):
    rng = random.Random(seed)
    text = text_of(rng, 300).encode()
    path = tmp_path / "t.vcf.gz"
    path.write_bytes(compress(text, rng.choice([3, 50, 997, 60_000])))
    assert gzip.decompress(path.read_bytes()) == text  # an ordinary reader sees plain gzip
    size = path.stat().st_size
    for step in (1 << 30, 4000, 700, 61):
        found = [x for start in range(0, size, step) for x in range_lines(f"file:{path}", start, start + step)]
        want = text.split(b"\n")
        assert [x for _, x in found] == (want[:-1] if want[-1] == b"" else want)
        assert all(a[0] < b[0] for a, b in zip(found, found[1:]))


def test_headers_inside_compressed_data_are_not_members():
    first = member(b"abc")
    assert member_size(first, 0) == len(first) and member_size(first, 1) is None and member_size(first[:17], 0) is None


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", "##reference=hg38", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA"]
    body = [f"chr1\t{n}\t.\tA\tC,G\t.\tPASS\tGENE=G{n}\tGT:DP\t{'0/1' if n % 3 else '1/2'}:{n}" for n in range(1, 2000)]
    text = "\r\n".join([*head, *body, ""])
    (tmp_path / "one.vcf.gz").write_bytes(compress(text.encode(), 2000))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "one.vcf").write_text(text, newline="")
    lines = read_block_gzip(spark, str(tmp_path / "one.vcf.gz"), range_bytes=4096)
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
    assert [r["value"] for r in lines.orderBy("line_no").collect()] == [*head, *body]
    columns = ["sample_id", "chrom", "pos", "alt", "gene", "zygosity", "depth", "build"]
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (parse_calls(lines), read_vcf(spark, str(tmp_path / "plain" / "one.vcf"))))
    assert got == want and len(got) == 2 * 1999


def test_ordinary_gzip_and_empty_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as out:
        out.write("x\ny" * 50_000)
    with gzip.open(tmp_path / "a.vcf.gz", "at") as out:  # a second member
        out.write("\nlast\n")
    (tmp_path / "b.vcf.gz").write_bytes(compress(b""))
    got = read_block_gzip(spark, str(tmp_path), range_bytes=100)
    want = read_lines(spark, str(tmp_path / "a.vcf.gz"))
    assert [r["value"] for r in got.orderBy("line_no").collect()] == [r["value"] for r in want.orderBy("line_no").collect()]


def test_written_parts_are_read_back(spark, tmp_path):
    lines = spark.range(30_000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).coalesce(2)
    write_block_gzip(lines, f"file:{tmp_path}/out")
    back = read_block_gzip(spark, str(tmp_path / "out"), range_bytes=20_000)
    assert sorted(r["value"] for r in back.collect()) == sorted(r["value"] for r in lines.collect())
    assert len(list((tmp_path / "out").glob("*"))) == 2 and back.select("file").distinct().count() == 2

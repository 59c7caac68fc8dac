"""Ontology and gene-to-phenotype sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources.lines import tab_fields


def read_obo(spark: SparkSession, path: str, prefix: str = "HP:") -> DataFrame:
    """Stanzas are separated by blank lines, so the reader can split on them directly."""
    return parse_obo(spark.read.text(path, lineSep="\n\n"), prefix)


def parse_obo(stanzas: DataFrame, prefix: str = "HP:") -> DataFrame:
    """Live term stanzas as ``term, name, parents``."""
    lines = F.col("lines")
    starting = lambda tag: F.filter(lines, lambda x: x.startswith(tag))
    after = lambda c, tag: F.trim(F.substr(c, F.lit(len(tag) + 1)))
    identifier = F.get(starting("id: " + prefix), F.lit(0))
    names = starting("name:")
    return (
        stanzas.select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
        .where(
            F.array_contains("lines", "[Term]")
            & identifier.isNotNull()
            & (F.size(starting("is_obsolete: true")) == 0)
        )
        .select(
            after(identifier, "id:").alias("term"),
            after(F.get(names, F.size(names) - 1), "name:").alias("name"),
            F.transform(
                starting("is_a:"),
                lambda x: F.trim(F.substring_index(F.substr(x, F.lit(6)), "!", 1)),
            ).alias("parents"),
        )
    )


def parse_graph(lines: DataFrame) -> DataFrame:
    """Graph table rows ``term, name, ic, parents``; an unreadable information content is 0."""
    rows = tab_fields(lines, "term", "name", "ic", "parents").where(F.col("ic").isNotNull())
    return rows.select(
        "term",
        "name",
        F.coalesce(F.col("ic").try_cast("double"), F.lit(0.0)).alias("ic"),
        F.filter(F.split(F.coalesce("parents", F.lit("")), "[|]"), lambda p: p != "").alias("parents"),
    )


def is_a_edges(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def gene_terms(lines: DataFrame) -> DataFrame:
    """``gene, term, name`` annotation rows, one per pair."""
    rows = tab_fields(lines, "gene", "term", "name").where(F.col("term").isNotNull())
    return rows.groupBy("gene", "term").agg(F.max_by("name", "line_no").alias("name"))


def gene_terms_from_release(lines: DataFrame) -> DataFrame:
    """Release table: columns 2 to 4, header skipped, first name kept per pair."""
    rows = tab_fields(lines, "gene_id", "gene", "term", "name").where(
        ~F.col("gene_id").startswith("ncbi_gene_id") & F.col("name").isNotNull()
    )
    return rows.groupBy("gene", "term").agg(F.min_by("name", "line_no").alias("name"))


def listed_terms(lines: DataFrame) -> DataFrame:
    """Patient term files: first token of each line that is neither blank nor a comment."""
    text = F.trim("value")
    return lines.where((text != "") & ~text.startswith("#")).select(
        "file", "line_no", F.get(F.split(text, r"\s+"), F.lit(0)).alias("term")
    )


def inline_terms(text: Column) -> Column:
    """Term ids written anywhere in free text, in upper case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"((?i)HP:\d+)"), 1), F.upper)

"""Assertion-record documents (nested JSON) as comparable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.keys import bare_contig
from locusflow.settings import GENOME_BUILD

LOCATION = "struct<assembly_name:string,chr:string,start:string,ref:string,alt:string>"
CLASSIFICATION = (
    "struct<description:string,review_status:string,last_evaluated:string,"
    "trait_set:array<struct<trait_name:string>>>"
)
RECORD = f"""
accession string, title string,
variation_set array<struct<canonical_spdi:string,variation_loc:array<{LOCATION}>>>,
germline_classification {CLASSIFICATION},
clinical_significance {CLASSIFICATION},
trait_set array<struct<trait_name:string>>,
molecular_consequence_list array<string>
"""


def parse_records_json(documents: DataFrame, value: str = "value") -> DataFrame:
    others = [x for x in documents.columns if x != value]
    return documents.select(*others, F.from_json(value, RECORD).alias("r")).select(*others, "r.*")


def located_alleles(sets: Column) -> Column:
    """Locations of the wanted build; missing alleles are filled from the set's SPDI."""

    def of_set(s: Column) -> Column:
        spdi = F.split(s["canonical_spdi"], ":")
        part = lambda back: F.when(F.size(spdi) >= 4, F.get(spdi, F.size(spdi) - back))
        text = lambda x: F.when(x != "", x)
        here = F.filter(
            F.coalesce(s["variation_loc"], F.array()),
            lambda x: F.upper(x["assembly_name"]) == GENOME_BUILD.upper(),
        )
        return F.transform(
            here,
            lambda x: F.struct(
                x["chr"].alias("chr"),
                x["start"].alias("start"),
                F.upper(F.coalesce(text(x["ref"]), text(part(2)))).alias("ref"),
                F.upper(F.coalesce(text(x["alt"]), text(part(1)))).alias("alt"),
            ),
        )

    return F.flatten(F.transform(F.coalesce(sets, F.array()), of_set))


def confirms_allele(sets: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """True only when position and both alleles are stated and equal."""
    return F.exists(
        located_alleles(sets),
        lambda x: F.coalesce(
            (x["chr"] == bare_contig(chrom))
            & (x["start"] == pos.cast("string"))
            & (x["ref"] == F.upper(ref))
            & (x["alt"] == F.upper(alt)),
            F.lit(False),
        ),
    )


def simple_snv_key(sets: Column) -> Column:
    """Key of the first single-base substitution among the locations, else NULL."""
    single = F.filter(
        located_alleles(sets),
        lambda x: x["ref"].rlike("^[ACGT]$")
        & x["alt"].rlike("^[ACGT]$")
        & (x["ref"] != x["alt"])
        & (x["chr"] != "")
        & (x["start"] != ""),
    )
    first = F.get(single, F.lit(0))
    parts = [F.regexp_replace(first["chr"], "chr", ""), first["start"], first["ref"], first["alt"]]
    return F.when(first.isNotNull(), F.concat_ws("-", *parts))


def record_fields(records: DataFrame) -> DataFrame:
    """Assertion fields from the current record shape, else from the legacy one."""
    text = lambda x: F.when(x != "", x)
    new, old = F.col("germline_classification"), F.col("clinical_significance")
    pick = lambda name: F.coalesce(text(new[name]), text(old[name]))
    filled = lambda a: F.when(F.size(a) > 0, a)
    traits = F.coalesce(filled(new["trait_set"]), filled(F.col("trait_set")), F.array())
    names = F.filter(F.transform(traits, lambda x: x["trait_name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return records.withColumns(
        {
            "significance": pick("description"),
            "review_status": pick("review_status"),
            "evaluated": pick("last_evaluated"),
            "condition": text(F.array_join(names, "; ")),
        }
    )

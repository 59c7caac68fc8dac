"""Questions over classified and routed result tables; those on criteria need the trail (``combine.explained``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.keys import variant_key
from locusflow.operators.ranking import position_in_group
from locusflow.operators.routing import not_to_dismiss_columns
from locusflow.settings import BUCKETS

c = F.col


def bucket_memberships() -> Column:
    """All report buckets one routed call belongs to."""
    return F.array_compact(
        F.array(
            F.when(c("bucket") == "primary", "primary"),
            F.when(c("bucket") == "secondary", "secondary"),
            F.when(c("carrier"), "carrier"),
            F.when(c("probable_vus"), "probable_pathogenic_vus"),
            F.when(c("bucket") == "other", "other"),
        )
    )


def case_overview(routed: DataFrame) -> DataFrame:
    has = lambda name: F.count_if(F.array_contains("_in", name)).alias(f"n_{name}")
    return (
        routed.withColumn("_in", bucket_memberships())
        .groupBy("sample_id")
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            *[has(b) for b in BUCKETS],
            F.count_if("not_to_dismiss").alias("n_not_to_dismiss"),
        )
    )


#: Findings, and conclusion items, of one part of a sample's document.
PART_ITEMS = 5_000
FINDING = ["line_no", "alt_index", "gene", "consequence", "hgvs_p", "tier", "rule_path", "bucket", "carrier", "probable_vus", "hpo_match_score"]


def _parts(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Rows with the part of their sample's document and their place in it, at most ``most`` a part."""
    placed = position_in_group(rows, ["sample_id"], [c(o).asc_nulls_first() for o in order], "_place")
    return placed.withColumn("part", F.floor((c("_place") - 1) / most).cast("int"))


def sample_documents(
    routed: DataFrame, conclusions: DataFrame, patient_terms: DataFrame, most: int = PART_ITEMS
) -> DataFrame:
    """The result of every sample as nested documents: header, buckets, conclusion, flags and findings.

    A sample is one document, or several numbered parts if it has more than ``most``
    findings or conclusion items, so no document grows without bound. Every part has the header;
    genes of the buckets, flags and findings stand in the order of the calls. A sample that only
    has conclusions has a document without findings.
    """
    in_order = lambda value, keep=F.lit(True): F.transform(
        F.array_sort(F.collect_list(F.when(keep, F.struct("_place", value.alias("v"))))), lambda x: x["v"]
    )
    order = ["line_no", "alt_index", "gene"]
    slim = routed.select(
        "sample_id", *order, bucket_memberships().alias("_in"), F.struct(*[x for x in FINDING if x in routed.columns]).alias("_finding"),
        F.when(c("not_to_dismiss"), F.struct(*not_to_dismiss_columns())).alias("_flag"),
    )
    found = _parts(slim, order, most).groupBy("sample_id", "part").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.struct(*[in_order(c("gene"), F.array_contains("_in", b)).alias(b) for b in BUCKETS]).alias("buckets"),
        in_order(c("_flag"), c("_flag").isNotNull()).alias("not_to_dismiss"),
        in_order(c("_finding")).alias("findings"),
    )
    item = F.struct("section_no", "section", "gene", "detail")
    said = _parts(conclusions, ["section_no", "gene", "detail"], most).groupBy("sample_id", "part").agg(
        in_order(item).alias("conclusion")
    )
    build = c("build") if "build" in routed.columns else F.lit(None).cast("string")
    told = routed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.max(build).alias("build"))
    terms = patient_terms.select("sample_id", "term").distinct().groupBy("sample_id").agg(F.array_sort(F.collect_list("term")).alias("hpo_terms"))
    joined = found.join(said, ["sample_id", "part"], "full").join(told, "sample_id", "left").join(terms, "sample_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "sample_id", "part", "build", F.coalesce("hpo_terms", none).alias("hpo_terms"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        *[F.coalesce(c(x), F.from_json(F.lit("[]"), found.schema[x].dataType)).alias(x) for x in ("not_to_dismiss", "findings")],
        F.coalesce("buckets", F.struct(*[none.alias(b) for b in BUCKETS])).alias("buckets"),
        F.coalesce("conclusion", F.from_json(F.lit("[]"), said.schema["conclusion"].dataType)).alias("conclusion"),
    )


def overview(documents: DataFrame) -> DataFrame:
    """One row a sample: header, number of calls in each bucket, and the conclusion of its first part."""
    first = lambda x: F.min_by(c(x), c("part")).alias(x)
    return documents.groupBy("sample_id").agg(
        first("build"), first("hpo_terms"), first("n_candidates"),
        *[F.sum(F.size(f"buckets.{b}")).alias(f"n_{b}") for b in BUCKETS],
        F.sum(F.size("not_to_dismiss")).alias("n_not_to_dismiss"), first("conclusion"),
    )


def findings_for_gene(routed: DataFrame, gene: str) -> DataFrame:
    return routed.where(F.upper("gene") == gene.upper())


def variants_in_bucket(routed: DataFrame, bucket: str, by_gene: bool = True) -> DataFrame:
    """Calls of a bucket. Gene-level by default: every call of a gene that has one member."""
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}; valid: {', '.join(BUCKETS)}")
    members = routed.where(F.array_contains(bucket_memberships(), bucket))
    if not by_gene:
        return members
    return routed.join(members.select("sample_id", "gene").distinct(), ["sample_id", "gene"], "left_semi")


def criterion_rows(classified: DataFrame) -> DataFrame:
    """Long audit table: one row per call and criterion."""
    return classified.select(
        "sample_id", "gene", variant_key().alias("variant"), F.coalesce("hgvs_p", "hgvs_c").alias("hgvs"),
        "tier", F.explode("criteria").alias("k"),
    ).select("sample_id", "gene", "variant", "hgvs", "tier", "k.*")


def criterion_basis(classified: DataFrame, gene: str, code: str) -> DataFrame:
    rows = criterion_rows(findings_for_gene(classified, gene)).where(F.upper("code") == code.upper())
    return rows.withColumn("strength", F.coalesce("applied_strength", "default_strength"))


def findings_resting_on_assertions(classified: DataFrame) -> DataFrame:
    """Met criteria that draw on a clinical assertion, by code or by citation."""
    cited = F.exists("citation", lambda s: F.lower(s).contains("clinvar") | F.lower(s).startswith("vcv"))
    return criterion_rows(classified).where(c("met") & (c("code").isin("PP5", "BP6") | F.coalesce(cited, F.lit(False))))


def gene_digest(routed: DataFrame, gene: str) -> DataFrame:
    """All calls of a gene with the buckets any call of that gene fell into."""
    calls = findings_for_gene(routed, gene)
    membership = (
        calls.select("sample_id", F.explode(bucket_memberships()).alias("b"))
        .groupBy("sample_id")
        .agg(F.array_join(F.sort_array(F.collect_set("b")), ",").alias("buckets"))
    )
    return calls.join(membership, "sample_id", "left").select(
        "sample_id", variant_key().alias("variant"), "hgvs_c", "hgvs_p", "consequence", "zygosity", "tier",
        "rule_path", F.array_join("met_codes", " ").alias("met_codes"), "clinvar_significance", "gnomad_af",
        "am_pathogenicity", "hpo_match_score", "buckets",
    )


def findings_table(routed: DataFrame) -> DataFrame:
    return routed.select(
        "sample_id", "gene", variant_key().alias("variant"), F.coalesce("hgvs_p", "hgvs_c").alias("hgvs"),
        "consequence", "zygosity", "tier", F.array_join("met_codes", " ").alias("met_codes"), "bucket",
        "gnomad_af", "clinvar_significance", "hpo_match_score",
    )

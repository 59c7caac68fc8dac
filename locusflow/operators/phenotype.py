"""Ontology closure, information content and gene-phenotype similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.consequences import literal_map
from locusflow.operators.durable import durable
from locusflow.operators.skew import attach
from locusflow.settings import DEFAULTS, INHERITANCE_TERMS, Thresholds


def ancestor_closure(terms: DataFrame, is_a: DataFrame) -> DataFrame:
    """``term, ancestor`` for every term including itself.

    Each round joins the closure with itself, so path length doubles: the number of
    rounds is the logarithm of the depth. Cycles end because rows are distinct.
    """
    named = terms.select("term").unionByName(is_a.select(F.col("child").alias("term"))).distinct()
    own = named.select("term", F.col("term").alias("ancestor"))
    direct = is_a.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"))
    closure = durable(own.unionByName(direct).distinct())
    known_rows = closure.count()
    while True:
        upper = closure.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("far"))
        closure = durable(
            closure.join(upper, "ancestor").select("term", F.col("far").alias("ancestor")).distinct()
        )
        rows = closure.count()
        if rows == known_rows:
            return closure
        known_rows = rows


def information_content(terms: DataFrame, gene_terms: DataFrame, closure: DataFrame) -> DataFrame:
    """``term, ic``: minus log of the share of genes at the term or below it, 4 digits."""
    annotated = gene_terms.select("gene", "term").join(terms.select("term"), "term", "left_semi")
    reached = (
        annotated.join(closure, "term")
        .select("ancestor", "gene")
        .distinct()
        .groupBy(F.col("ancestor").alias("term"))
        .agg(F.count(F.lit(1)).alias("n_genes"))
    )
    total = annotated.agg(F.greatest(F.countDistinct("gene"), F.lit(1))).scalar()
    share = F.greatest(F.coalesce("n_genes", F.lit(0)), F.lit(1)) / total
    return terms.select("term").join(reached, "term", "left").select(
        "term", F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.round(-F.log(share), 4).alias("ic")
    )


def gene_ancestor_profile(gene_terms: DataFrame, closure: DataFrame, ic: DataFrame, name_terms: bool) -> DataFrame:
    """For each gene and informative ancestor, the gene's broadest term under it.

    With the ancestor fixed, similarity grows as the gene term's own content falls, so
    this one term stands for all of the gene's terms below that ancestor and no term
    pairs need to be formed. Without ``name_terms`` only its content is kept.
    """
    content = ic.select("term", F.col("ic").alias("term_ic"))
    above = ic.where(F.col("ic") > 0).select(F.col("term").alias("ancestor"), F.col("ic").alias("ancestor_ic"))
    reached = gene_terms.select("gene", "term").join(closure, "term").join(above, "ancestor").join(content, "term")
    lowest = F.min(F.struct("term_ic", F.col("term").alias("gene_term")))
    grouped = reached.groupBy("gene", "ancestor", "ancestor_ic")
    if name_terms:
        return grouped.agg(lowest.alias("b")).select("gene", "ancestor", "ancestor_ic", "b.term_ic", "b.gene_term")
    return grouped.agg(F.min("term_ic").alias("term_ic"))


def best_matches(
    pairs: DataFrame, gene_terms: DataFrame, closure: DataFrame, ic: DataFrame, name_terms: bool = True
) -> DataFrame:
    """Best Lin similarity of each (gene, patient term) pair and, if asked, the gene term giving it.

    ``pairs`` are distinct. Ties go to the smaller term id. Pairs sharing no informative
    ancestor are left out (their similarity is 0); an identical term scores 1 even when
    it carries no information. Plain maxima aggregate in hash tables, so the term names
    are carried only on request.
    """
    profile = gene_ancestor_profile(gene_terms, closure, ic, name_terms)
    content = ic.select("term", F.col("ic").alias("patient_ic"))
    both = F.col("patient_ic") + F.col("term_ic")
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * F.col("ancestor_ic") / both))
    named = ["gene_term"] if name_terms else []
    terms = closure.join(content, "term")
    shared = (
        pairs.select("gene", "term")
        .join(terms, "term")
        .join(profile, ["gene", "ancestor"])
        .where(both > 0)
        .select("gene", "term", similarity.alias("similarity"), *named)
    )
    identical = pairs.select("gene", "term").join(gene_terms.select("gene", "term").distinct(), ["gene", "term"], "left_semi")
    exact = identical.withColumns({"similarity": F.lit(1.0), **{n: F.col("term") for n in named}})
    grouped = shared.unionByName(exact).groupBy("gene", "term")
    if name_terms:
        first = F.min(F.struct((-F.col("similarity")).alias("s"), "gene_term")).alias("b")
        best = grouped.agg(first).select("gene", "term", (-F.col("b.s")).alias("similarity"), "b.gene_term")
    else:
        best = grouped.agg(F.max("similarity").alias("similarity"))
    return best.where(F.col("similarity") > 0)


def sample_gene_pairs(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("gene").isNotNull()).select("sample_id", "gene").distinct()


def term_matches(
    sample_genes: DataFrame, patient_terms: DataFrame, gene_terms: DataFrame, closure: DataFrame, ic: DataFrame,
    name_terms: bool = True,
) -> DataFrame:
    """Best gene term for each listed term of each sample's genes (repeats kept).

    The similarity is computed once per distinct (gene, term) and goes to the listed terms, which
    are many more, if it is small as measured; so those stay with their samples.
    """
    wanted = sample_genes.join(patient_terms.select("sample_id", "term"), "sample_id")
    best = best_matches(wanted.select("gene", "term").distinct(), gene_terms, closure, ic, name_terms)
    return attach(wanted, best, ["gene", "term"], ["sample_id"]).where(F.col("similarity").isNotNull())


def phenotype_scores(
    sample_genes: DataFrame,
    patient_terms: DataFrame,
    gene_terms: DataFrame,
    closure: DataFrame,
    ic: DataFrame,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """``hpo_match_score`` (average over all listed terms) and ``hpo_best_match`` per sample and gene.

    Genes without any match are left out; read their score as 0.
    """
    listed = patient_terms.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_terms"))
    matched = term_matches(sample_genes, patient_terms, gene_terms, closure, ic, name_terms=False)
    per_gene = matched.groupBy("sample_id", "gene").agg(
        F.sum("similarity").alias("_sum"),
        F.round(F.max("similarity"), 3).alias("hpo_best_match"),
        F.count_if(F.col("similarity") >= t.matched_similarity).cast("int").alias("n_matched_terms"),
    )
    return per_gene.join(listed, "sample_id").select(
        "sample_id",
        "gene",
        F.round(F.col("_sum") / F.col("n_terms"), 3).alias("hpo_match_score"),
        "hpo_best_match",
        "n_matched_terms",
    )


def matched_terms(
    sample_genes: DataFrame, patient_terms: DataFrame, gene_terms: DataFrame, closure: DataFrame, ic: DataFrame,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Per sample and gene the listed terms the gene matches, each with its best gene term and similarity.

    Terms below the match threshold are left out, genes without a match too; the list is
    in term order and no longer than the sample's own.
    """
    found = term_matches(sample_genes, patient_terms, gene_terms, closure, ic).where(F.col("similarity") >= t.matched_similarity)
    return found.groupBy("sample_id", "gene").agg(
        F.array_sort(F.collect_list(F.struct("term", "gene_term", "similarity"))).alias("matched_terms")
    )


def overlap_scores(sample_genes: DataFrame, patient_terms: DataFrame, gene_terms: DataFrame) -> DataFrame:
    """Score without an ontology: share of the distinct patient terms the gene carries."""
    distinct_terms = patient_terms.select("sample_id", "term").distinct()
    listed = distinct_terms.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_terms"))
    shared = (
        sample_genes.join(distinct_terms, "sample_id")
        .join(gene_terms.select("gene", "term").distinct(), ["gene", "term"], "left_semi")
        .groupBy("sample_id", "gene")
        .agg(F.count(F.lit(1)).cast("int").alias("n_matched_terms"))
    )
    return shared.join(listed, "sample_id").select(
        "sample_id",
        "gene",
        F.round(F.col("n_matched_terms") / F.col("n_terms"), 3).alias("hpo_match_score"),
        F.lit(1.0).alias("hpo_best_match"),
        "n_matched_terms",
    )


def with_phenotype(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """Add the scores to calls; no gene, no terms and no match all read as 0.

    A task holds its narrow scores in a hash table, so the wide calls are not sorted.
    """
    joined = calls.join(scores.hint("shuffle_hash"), ["sample_id", "gene"], "left")
    return joined.withColumns(
        {
            "hpo_match_score": F.coalesce("hpo_match_score", F.lit(0.0)),
            "hpo_best_match": F.coalesce("hpo_best_match", F.lit(0.0)),
            "n_matched_terms": F.coalesce("n_matched_terms", F.lit(0)),
        }
    )


def inheritance_modes(gene_terms: DataFrame, vocabulary: dict[str, str] = INHERITANCE_TERMS) -> DataFrame:
    """``gene`` in upper case with its sorted modes and a joined label."""
    mode = F.element_at(literal_map(vocabulary), F.col("term"))
    modes = F.sort_array(F.collect_set("mode"))
    return (
        gene_terms.select(F.upper("gene").alias("gene"), mode.alias("mode"))
        .where(F.col("mode").isNotNull())
        .groupBy("gene")
        .agg(modes.alias("modes"))
        .withColumn("label", F.array_join("modes", "+"))
    )

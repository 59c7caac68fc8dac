"""Variant-analysis relations derived from the star-schema tables.

The texts use only SQL both Spark and DuckDB read alike, with table names in braces, so
the two sides start from identical rows. They define input data only; what the
operators do with it is written separately on each side.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _base(k: str) -> str:
    return f"substr('ACGT', CAST(1 + ({k}) % 4 AS INT), 1)"


def _ref(k: str) -> str:
    return f"{_base(k)} || CASE {k} % 9 WHEN 1 THEN 'TG' WHEN 7 THEN 'CAT' ELSE '' END"


def _alt(k: str) -> str:
    return f"CASE WHEN {k} % 9 IN (1, 7) THEN {_base(k)} ELSE {_base(k + ' + 1')} END"


def _chrom(k: str) -> str:
    return f"'chr' || (1 + {k} % 22)"


def _pos(k: str, extra: str = "0") -> str:
    return f"CAST(1000 + ({k} * 100) % 2000000000 + {extra} AS INT)"


def _consequence(k: str) -> str:
    return (
        f"CASE {k} % 9 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'frameshift_variant' "
        "WHEN 2 THEN 'splice_donor_variant' WHEN 3 THEN 'start_lost' WHEN 6 THEN 'synonymous_variant' "
        "WHEN 7 THEN 'inframe_deletion' WHEN 8 THEN 'intron_variant' ELSE 'missense_variant' END"
    )


_K, _P = "l_partkey", "p_partkey"
_LEAF = "'L' || c_nationkey || '-' || c_mktsegment || '-' || (c_custkey % 30)"
_SEGMENT = "'M' || c_nationkey || '-' || c_mktsegment"
_CUBE = "CAST(p_size * p_size * p_size AS DOUBLE)"

RELATIONS = {
    "calls": f"""
SELECT 'S' || l_suppkey AS sample_id, {_chrom(_K)} AS chrom,
  {_pos(_K, "CASE WHEN l_orderkey % 8 = 0 THEN 7 ELSE 0 END")} AS pos,
  {_ref(_K)} AS ref,
  CASE WHEN l_linenumber % 3 = 0 AND {_K} % 3 <> 0 THEN {_base(_K + ' + 1 + ' + _K + ' % 3')} ELSE {_alt(_K)} END AS alt,
  'GENE' || ({_K} % 150) AS gene, {_consequence(_K)} AS consequence,
  CASE WHEN {_K} % 10 <> 0 THEN (1 + {_K} % 5) || '/5' END AS exon,
  'NM_' || ({_K} % 150) AS transcript, 'c.' || {_K} || 'A>G' AS hgvs_c, 'p.Ala' || {_K} || 'Gly' AS hgvs_p,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 IN (1, 2) THEN 'hom'
       WHEN l_orderkey % 10 = 3 THEN 'hemi' ELSE 'het' END AS zygosity,
  CAST(l_quantity AS INT) AS depth, CAST(5 + l_orderkey % 95 AS INT) AS gq,
  CAST(20 + (l_orderkey * 7) % 60 AS DOUBLE) / 100 AS allele_balance,
  CASE WHEN l_orderkey % 17 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter_status,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'rs' || l_orderkey END AS variant_id,
  CASE WHEN {_K} % 10 = 0 THEN 2 ELSE 1 END AS n_alts,
  CASE WHEN {_K} % 10 = 0 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS alt_index,
  (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS line_no
FROM {{lineitem}}""",
    "freq_store": f"""
SELECT {_chrom(_P)} AS chrom, {_pos(_P, f"CASE WHEN {_P} % 5 = 0 THEN 50 ELSE 0 END")} AS pos,
  {_ref(_P)} AS ref, {_alt(_P)} AS alt,
  CASE WHEN {_P} % 11 = 0 THEN 'AC0' ELSE 'PASS' END AS filter,
  {_CUBE} / 1100000 AS af,
  CASE WHEN {_P} % 13 <> 0 THEN {_CUBE} / 1000000 END AS af_grpmax,
  CAST(p_size * 10 AS BIGINT) AS ac, CAST(100000 + p_size AS BIGINT) AS an, CAST(p_size % 4 AS BIGINT) AS nhomalt,
  CASE WHEN {_P} % 7 <> 0 THEN {_CUBE} * 8 / 10000000 END AS faf95,
  CASE {_P} % 3 WHEN 0 THEN 'nfe' WHEN 1 THEN 'afr' ELSE 'fin' END AS grpmax_pop
FROM {{part}}""",
    "assertion_store": f"""
SELECT {_chrom(_P)} AS chrom, {_pos(_P)} AS pos, {_ref(_P)} AS ref, {_alt(_P)} AS alt,
  CASE {_P} % 12 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Benign' WHEN 3 THEN 'Likely benign'
    WHEN 6 THEN 'Conflicting interpretations of pathogenicity' WHEN 9 THEN 'Likely pathogenic' ELSE '' END AS significance,
  CASE {_P} % 5 WHEN 0 THEN 'criteria_provided,_multiple_submitters,_no_conflicts'
    WHEN 1 THEN 'no_assertion_criteria_provided' WHEN 2 THEN 'reviewed_by_expert_panel'
    WHEN 3 THEN 'criteria_provided,_single_submitter' ELSE 'practice_guideline' END AS review_status,
  'VCV' || {_P} AS accession, 'condition ' || ({_P} % 40) AS condition
FROM {{part}}""",
    "score_rows": " UNION ALL ".join(
        f"""
SELECT {_chrom(_P)} AS chrom, {_pos(_P, f"CASE WHEN {_P} % 2 = 1 THEN 30 ELSE 0 END")} AS pos,
  {_ref(_P)} AS ref, {_alt(_P)} AS alt, {tx} AS transcript_no,
  CAST(({_P} * 37 + {tx} * 211) % 1000 AS DOUBLE) / 1000 AS am_pathogenicity,
  'class' || (({_P} + {tx}) % 3) AS am_class
FROM {{part}}"""
        for tx in (1, 2, 3)
    ),
    "local_freq": f"""
SELECT (1 + {_P} % 22) || '-' || {_pos(_P, f"CASE WHEN {_P} % 4 = 0 THEN 0 ELSE 33 END")} || '-' || {_ref(_P)} || '-' || ({_alt(_P)}) AS key,
  CAST(p_size AS DOUBLE) / 3000 AS af
FROM {{part}}""",
    "predictors": f"""
SELECT (1 + {_P} % 22) || '-' || {_pos(_P)} || '-' || {_ref(_P)} || '-' || ({_alt(_P)}) AS key,
  CASE WHEN {_P} % 6 <> 0 THEN CAST(({_P} * 13) % 100 AS DOUBLE) / 100 END AS revel,
  CASE WHEN {_P} % 4 <> 0 THEN CAST(({_P} * 7) % 40 AS DOUBLE) END AS cadd
FROM {{part}}""",
    "gene_numbers": f"SELECT DISTINCT {_P} % 150 AS g FROM {{part}}",
    "gene_constraint": """
SELECT CASE WHEN g % 5 = 4 THEN 'OTHER' ELSE 'GENE' END || g AS gene,
  CASE WHEN g % 5 = 0 THEN 0.95e0 WHEN g % 5 = 2 THEN NULL ELSE 0.1e0 END AS pli,
  CASE WHEN g % 5 = 1 THEN 0.2e0 WHEN g % 5 = 3 THEN NULL ELSE 0.8e0 END AS loeuf
FROM gene_numbers""",
    "haploinsufficient": "SELECT CASE WHEN g % 11 = 0 THEN 'gene' ELSE 'other' END || g AS gene FROM gene_numbers",
    "secondary_genes": "SELECT CASE WHEN g % 13 = 0 THEN 'GENE' ELSE 'gene' END || g AS gene FROM gene_numbers",
    "is_a": f"""
SELECT DISTINCT {_LEAF} AS child, {_SEGMENT} AS parent FROM {{customer}}
UNION ALL SELECT DISTINCT {_SEGMENT}, 'N' || c_nationkey FROM {{customer}}
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM {{nation}}
UNION ALL SELECT 'N' || n_nationkey, 'R' || (n_regionkey + 1) % 5 FROM {{nation}} WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM {{region}}""",
    "terms": "SELECT child AS term FROM is_a UNION SELECT parent FROM is_a",
    "phenotype_terms": f"""
SELECT 'GENE' || (o_orderkey % 150) AS gene, {_LEAF} AS term FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION SELECT 'GENE' || (c_custkey % 50), {_LEAF} FROM {{customer}}
UNION SELECT 'GENE' || (50 + c_custkey % 25), {_LEAF} FROM {{customer}}
UNION SELECT 'GENE' || (75 + c_custkey % 75), {_LEAF} FROM {{customer}}""",
    "mode_terms": """
SELECT 'gene' || g AS gene,
  CASE g % 6 WHEN 0 THEN 'HP:0000006' WHEN 1 THEN 'HP:0000007' WHEN 2 THEN 'HP:0000006'
    WHEN 3 THEN 'HP:0001419' WHEN 5 THEN 'HP:0000007' ELSE 'HP:0000118' END AS term FROM gene_numbers
UNION ALL SELECT 'GENE' || g, CASE g % 6 WHEN 2 THEN 'HP:0000007' ELSE 'HP:0000118' END FROM gene_numbers""",
    "gene_terms": "SELECT gene, term FROM phenotype_terms UNION ALL SELECT gene, term FROM mode_terms",
    "patient_terms": f"""
SELECT 'S' || (c_custkey % (SELECT count(*) FROM {{supplier}})) AS sample_id, {_LEAF} AS term FROM {{customer}}""",
    "regions": f"""
SELECT 'chr' || (1 + j % 22) AS chrom, 1000 + (j * 100) % 2000000000 - o_custkey % 150 AS start,
  1000 + (j * 100) % 2000000000 - o_custkey % 150 + 20 + o_custkey % 200 AS "end"
FROM (SELECT o_orderkey % (2 * (SELECT count(*) FROM {{part}})) AS j, o_custkey FROM {{orders}}) o""",
    "answer_key": "SELECT sample_id, min_by(gene, line_no) AS gene FROM calls GROUP BY sample_id",
    "panel": f"""
SELECT (1 + {_P} % 22) || '-' || {_pos(_P)} || '-' || {_ref(_P)} || '-' || ({_alt(_P)}) AS key,
  'GENE' || ({_P} % 150) AS gene, {_consequence(_P)} AS consequence, 'p.Ala' || {_P} || 'Gly' AS hgvs_p,
  CASE {_P} % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Benign' WHEN 2 THEN 'Likely pathogenic'
    ELSE 'Uncertain significance' END AS clinvar_significance,
  'criteria provided, single submitter' AS review_status, 'VCV' || {_P} AS accession, 'x' AS condition
FROM {{part}}""",
    "frozen_freq": f"""
SELECT (1 + {_P} % 22) || '-' || {_pos(_P)} || '-' || {_ref(_P)} || '-' || ({_alt(_P)}) AS key,
  CASE WHEN {_P} % 9 <> 4 THEN {_CUBE} / 1000000 END AS af, CASE WHEN {_P} % 7 <> 0 THEN {_CUBE} * 8 / 10000000 END AS faf95,
  CAST(p_size % 4 AS BIGINT) AS hom
FROM {{part}}""",
    "cases": f"""
SELECT 'S' || s_suppkey AS sample_id, 'S' || s_suppkey AS case_id, s_suppkey AS case_no,
  'GENE' || (s_suppkey % 150) AS gene, {_chrom('s_suppkey')} AS chrom, {_pos('s_suppkey')} AS pos,
  {_ref('s_suppkey')} AS ref, {_alt('s_suppkey')} AS alt,
  CASE s_nationkey % 6 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'inframe_indel' WHEN 2 THEN 'stop_gained'
    WHEN 3 THEN 'frameshift_variant' WHEN 4 THEN 'start_lost' ELSE 'other' END AS consequence
FROM {{supplier}}""",
}
_RESERVED_END = re.compile(r'"end"')


def needed(sql: str, definitions: dict[str, str]) -> list[str]:
    """Names of definitions the text uses, directly or through others, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in definitions:
            if name != own and name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(definitions[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def register_tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Temporary views over the tables of one folder, by table name."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    views = {t: f"{t}_{tag}" for t in TABLES}
    for table, view in views.items():
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return views


def spark_relation(spark: SparkSession, views: dict[str, str], name: str) -> DataFrame:
    query = f"SELECT * FROM {name}"
    used = needed(query, RELATIONS)
    text = "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in used) + f"\n{query}"
    return spark.sql(_RESERVED_END.sub("`end`", text.format(**views)))


def oracle_relations() -> dict[str, str]:
    return {name: sql.format(**{t: t for t in TABLES}) for name, sql in RELATIONS.items()}

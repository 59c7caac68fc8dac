"""Registered queries of the subpackage and their SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run
from locusflow.llm import (
    byte_shards, chat_format, decontaminate, html_text, language_crf, lm_scoring, minhash_dedup, periodic_runs, piece_codec,
    quality_mil, spelling_variants, topk_search, toxicity,
)
from locusflow.llm.text import table

LLM_QUERIES = {}
LLM_STATEMENTS = {}


def registered(name: str, statement: str | None = None):
    def register(build):
        LLM_QUERIES[name] = build
        if statement is not None:
            LLM_STATEMENTS[name] = statement
        return build

    return register


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank", vec_id, score
  FROM pairs)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10
"""


@registered("op6_exact_top_k", TOP_K)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), 10)


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, 8 + length(role) + 1 + 7 + 1 + length(t)
    + length(regexp_replace(t, '[^\\]', '', 'g'))
    + length(regexp_replace(t, '<\|turn\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>',
        chr(1), 'g')) - length(regexp_replace(t, '<\|turn\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>',
        '', 'g')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewrites_history
FROM shown GROUP BY conv_id
"""


@registered("op10_chat_format", CHAT)
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


@registered("op9_minhash_dedup")
def minhash_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce("text", ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce("text", ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@registered("op1_decontaminate", DECONTAMINATE)
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@registered("op8_sentencepiece")
def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.token_report(table(spark, sf_dir, "documents"))


@registered("op3_language_crf")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = language_crf.identify(documents, language_crf.training_model(documents))
    return labelled.select(
        "doc_id", "held_out", "lang_pred", "score", "n_words", F.size("runs").cast("long").alias("n_runs")
    )


@registered("op5_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity(documents, toxicity.training_model(documents, table(spark, sf_dir, "labels")))


@registered("op7_quality_mil")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_mil.quality(documents, quality_mil.training_model(documents, table(spark, sf_dir, "labels")))


@registered("op4_html_text")
def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@registered("op2_lm_scoring")
def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


@registered("op11_periodic_runs")
def periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.run_digests(periodic_runs.with_runs(periodic_runs.planted(documents)))


@registered("op12_byte_shards")
def byte_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards.shard_report(table(spark, sf_dir, "documents"), 40)


@registered("op13_spelling_variants")
def spelling_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.with_slips(spelling_variants.word_runs(table(spark, sf_dir, "documents")))
    return spelling_variants.spelling_variants(spelling_variants.vocabulary(words))


registered("pipeline", ORACLE_SQL)(run)

import brute
import corpus_pipeline
from locusflow.llm import language_crf, piece_codec
from locusflow.llm.text import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_decide_as_plain_versions_do(spark):
    documents = table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    sure = stored(stages["language_id"](spark, documents, FOLDER))
    good = stored(stages["quality"](spark, sure, FOLDER))
    assert sure.columns == good.columns == documents.columns
    truth = {r["doc_id"]: r["quality"] for r in table(spark, FOLDER, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(truth.get(i) == 1 for i in kept) >= 0.9 * sum(q == 1 for q in truth.values())
    single = stored(stages["near_dedup"](spark, good, FOLDER))
    want = {i for i, (_, c) in brute.near_duplicates([(r["doc_id"], r["text"]) for r in good.collect()]).items() if i == c}
    assert {r["doc_id"] for r in single.collect()} == want
    clean = stored(stages["decontamination"](spark, single, FOLDER))
    rows = single.collect()
    items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    left = {r["doc_id"] for r, (_, hit, _) in zip(rows, brute.contaminated([r["text"] for r in rows], items)) if not hit}
    assert {r["doc_id"] for r in clean.collect()} == left and clean.columns == documents.columns
    coded = stages["sentencepiece"](spark, clean, FOLDER).collect()
    pieces = piece_codec.load()
    assert all(piece_codec.decode(pieces, r["token_ids"]) == r["text"] for r in coded)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(left)


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, token_ids string"
    text = "The cat and the dog of the house were in the garden with all the others."
    rows = [(1, text, "en", "s", None, "x"), (1, text, "en", "s", None, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, None), (None, text + " Again.", None, None, 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= {1, None}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_clean_text_of_three_languages_is_kept(spark):
    documents = table(spark, FOLDER, "documents").select("doc_id", "text", "lang")
    longest = {}
    for r in documents.collect():
        if r["lang"] and len(r["text"].split()) > len(longest.get(r["lang"], "").split()):
            longest[r["lang"]] = r["text"]
    mixed = " ".join(" ".join(longest[lang].split()[:40]) for lang in sorted(longest)[:3])
    rows = documents.union(spark.createDataFrame([(-7, mixed, None)], "doc_id bigint, text string, lang string"))
    model = language_crf.training_model(rows)
    found = language_crf.with_language(rows.where("doc_id = -7"), model).first()
    assert found["lang_score"] < 0.4 < found["lang_certainty"]
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, rows, FOLDER)
    assert kept.where("doc_id = -7").count() == 1 and kept.columns == rows.columns

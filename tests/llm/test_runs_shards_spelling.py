import random
import zlib
from collections import Counter

import brute
import pytest
from locusflow.llm import byte_shards, periodic_runs, spelling_variants
from locusflow.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c\x1cd"), (None, "x y " * 30), (6, "word " * 3000), (6, "word " * 3000), (8, "é" * 200_000)]
SCHEMA = "doc_id bigint, text string, runs string, collapsed int, size string, shard string, slot string, word string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "r", 1, "s", "h", "l", "w", "n") for i, t in ODD], SCHEMA)


def repetitive(rng):
    words = []
    while len(words) < rng.choice([5, 40, 120, 400]):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        words += [rng.choice(letters) for _ in range(rng.randrange(1, 12))] * rng.choice([1, 1, 2, 3, 5, 9, 20])
        if rng.random() < 0.3:
            words += words[-rng.randrange(1, 20) :] * rng.choice([1, 3])
    return words[:500]


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (7, 3), (40, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    texts = [" ".join(repetitive(rng)) for _ in range(120)] + [None, "", "a", " a  a "]
    runs, collapsed = periodic_runs.runs_of(texts, least, times)
    for text, got, kept in zip(texts, runs, collapsed):
        want, left = brute.periodic_runs((text or "").split(), least, times)
        assert got == want and kept == (None if text is None else " ".join(left))


def test_extensions_of_long_texts():
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") for _ in range(30_000)]
    text = ["x", *base * 3, *base[:11], "y", *["z"] * 100_000, *["u", "v"] * 12, "v"]
    runs, collapsed = periodic_runs.runs_of([" ".join(text)])
    long = [r for r in runs[0] if r[2] > 20 or r[0] >= 90_012]
    assert long == [(1, 90_011, 30_000), (90_013, 100_000, 1), (190_013, 24, 2)]
    assert len(collapsed[0].split()) <= 30_006


def test_runs_of_odd_rows(spark, odd):
    found = periodic_runs.with_runs(odd).collect()
    by_id = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in found}
    assert by_id == {
        1: ([], None), 2: ([], ""), 3: ([], ""), 4: ([], ODD[3][1]), None: ([(0, 60, 2)], "x y"), 6: ([(0, 3000, 1)], "word"),
        8: ([], ODD[7][1]),
    }
    assert len(found) == len(ODD) and all(r["shard"] == "h" and r["n"] == "n" for r in found)
    assert periodic_runs.run_digests(periodic_runs.with_runs(periodic_runs.planted(odd.limit(0)))).count() == 0
    digests = periodic_runs.run_digests(periodic_runs.with_runs(periodic_runs.planted(odd))).collect()
    assert sorted(map(tuple, digests), key=str) == sorted((brute.run_digests(*r) for r in ODD), key=str)


def test_runs_query_equals_brute_force(spark):
    got = sorted(map(tuple, LLM_QUERIES["op11_periodic_runs"](spark, FOLDER).collect()))
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(brute.run_digests(r["doc_id"], r["text"]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def in_order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))


def test_shards_equal_the_definition(spark):
    got = in_order(LLM_QUERIES["op12_byte_shards"](spark, FOLDER).collect())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert [r["doc_id"] for r in got] == sorted(texts)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in got)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    assert [r["shard"] for r in got] == brute.byte_shards([r["size"] for r in got], 40)
    for shard, rows in Counter(r["shard"] for r in got).items():
        assert [r["slot"] for r in got if r["shard"] == shard] == list(range(rows))


def test_shards_of_one_hot_key_and_odd_rows(spark, odd):
    rows = [(7 if i % 3 else i, "t" * (i % 50) or None) for i in range(3000)]
    dealt = byte_shards.shard_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 7).collect()
    held, largest = Counter(), max(r["size"] for r in dealt)
    for r in dealt:
        held[r["shard"]] += r["size"]
    assert len(dealt) == 3000 and set(held) == set(range(7))
    assert all(abs(held[s] - sum(held.values()) / 7) < largest for s in held)
    slots = Counter((r["shard"], r["slot"]) for r in dealt)
    assert set(slots.values()) == {1} and all((s, n - 1) in slots for s, n in Counter(r["shard"] for r in dealt).items())
    few = in_order(byte_shards.shard_report(odd, 40).collect())
    assert [r["shard"] for r in few] == brute.byte_shards([r["size"] for r in few], 40) and few[0]["doc_id"] is None
    assert sorted(r["size"] for r in few) == sorted(len((t or "").encode()) + 16 for _, t in ODD)
    assert byte_shards.shard_report(odd.limit(0), 40).count() == 0


def test_sizes_without_a_value(spark):
    rows = spark.createDataFrame([(1, None), (2, -5), (3, 0)], "k int, w int")
    assert [r["shard"] for r in byte_shards.balanced_shards(rows, "w", ["k"], 3).collect()] == [0, 0, 0]


def test_written_shards_hold_everything(spark, odd, tmp_path):
    byte_shards.write_shards(odd, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, ODD))
    assert set(odd.columns) | {"slot"} == set(back.columns)
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in byte_shards.shard_report(odd, 4).collect()}
    assert {(r["doc_id"], int(r["shard"]), r["slot"]) for r in back.collect()} == want


def counted(rows):
    counts = Counter(w for i, t in rows for w in brute.slipped_words(i, t))
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_variants_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in LLM_QUERIES["op13_spelling_variants"](spark, FOLDER).collect()}
    want = brute.spelling_variants(counted(rows))
    assert got == want and any(x[0] for x in want.values())


@pytest.mark.parametrize("block", [1, 3, 16, 512])
def test_variants_in_small_blocks(spark, block):
    rng, counts = random.Random(block), {}
    for stem in ("walking", "talking", "étudié", "aaaaaaa", "ÿÿÿÿÿÿ"):
        for _ in range(60):
            word = list(stem)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(word))
                word[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "k", "ab"])
            counts["".join(word)] = rng.choice([1, 5, 5, 25, 30, 200, 1000])
    counts |= {"b" * 3000: 5, "b" * 3001: 50, "b" * 3002: 250, "": 9, "c": 1}
    table = spark.createDataFrame([*((w, n, 1) for w, n in counts.items()), (None, 4, 1), ("none", None, 1)], "word string, n int, root int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.spelling_variants(table, 5, block).collect()}
    assert got == brute.spelling_variants(counts)
    assert got["b" * 3000][:2] == ("b" * 3001, "b" * 3002)


def test_words_of_odd_rows(spark, odd):
    words = spelling_variants.with_slips(spelling_variants.word_runs(odd, 1), 3)
    want = Counter(w for i, t in ODD for w in brute.slipped_words(i, t, 3))
    assert Counter(r["word"] for r in words.collect()) == want
    assert spelling_variants.spelling_variants(spelling_variants.vocabulary(words.limit(0))).count() == 0

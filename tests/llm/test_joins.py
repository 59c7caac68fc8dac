import hashlib
import math
import random

import brute
import pytest
from locusflow.llm import decontaminate, minhash_dedup
from locusflow.llm.components import components

SYLLABLES = ["an", "ber", "co", "di", "ßé", "fo", "gu", "hal"]
DOCUMENTS = "doc_id bigint, text string, key string, words string"


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_contamination_equals_brute_force(spark, broadcast_bytes):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 5, 9, 10, 14, 30])))) for i in range(12)]
    items += [(10, items[3][1]), (99, None), (98, ""), (97, "ÉTÉ Σας ΣΑΣ İx"), (11, items[4][1].upper() + "!")]
    texts = [None, "", " .,- ", "éTÉ", "x ÉTÉ Σας ΣΑΣ İX y", "x été σασ σας i̇x y"]
    for _ in range(25):
        parts = words(rng, rng.randrange(60))
        for _ in range(rng.randrange(3)):
            parts += (rng.choice(items)[1] or "").split() + words(rng, 2)
        texts.append(rng.choice(["-", " ", "\n* "]).join(parts))
    texts += [items[5][1] + " " + items[5][1], (items[6][1] + ". ").title(), texts[-1], texts[-1]]
    rows = [(None if i == 9 else min(i, 30), t, "k", "w") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, DOCUMENTS)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])
        for r in decontaminate.contaminated(table, benchmark, broadcast_bytes).collect()
    )
    want = sorted(
        (-1 if i is None else i, n, hit, len(named), hit > 0)
        for (i, *_), (n, hit, named) in zip(rows, brute.contaminated(texts, items))
    )
    assert got == want


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_contamination_where_only_folding_changes_small_letters(spark, broadcast_bytes):
    items = [(1, "ο λόγος του"), (2, "ο λόγοσ του"), (3, "phase Ⅲ trial"), (4, "phase ⅲ trial"), (5, "point ⓐ here"), (6, "point Ⓐ here")]
    texts = ["x ο λόγος του y", "x ο λόγοσ του y", "a phase Ⅲ trial", "a phase ⅲ trial", "at point Ⓐ here", "A POINT ⓐ HERE"]
    table = spark.createDataFrame([(i, t, "k", "w") for i, t in enumerate(texts)], DOCUMENTS)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"], r["n_hit"], r["items_sha256"]) for r in decontaminate.contaminated(table, benchmark, broadcast_bytes).collect())
    named = brute.contaminated(texts, items)
    assert [hit for _, hit, _ in named] == [3] * 6
    assert got == [(i, hit, hashlib.sha256(",".join(x).encode()).hexdigest()) for i, (_, hit, x) in enumerate(named)]
    assert decontaminate.without_contaminated(table.select("doc_id", "text"), benchmark).count() == 0


def test_contamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b", "", "")], DOCUMENTS)
    assert [r["contaminated"] for r in decontaminate.contaminated(some, none).collect()] == [False]
    assert decontaminate.contaminated(some.limit(0), none).count() == 0


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(SYLLABLES) * 3
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = words(rng, 220)
    texts = [" ".join(edited(rng, base, n)) for n in [0, 0, 1, 1, 2, 2, 3, 3, 4, 6, 9] * 8]
    chain = words(rng, 150)
    for _ in range(30):
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    texts += [None, "", " \n", "one two", "ONE two", "one two three four five", " ".join(words(rng, 40))] + [texts[0]] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, "k", "w") for i, t in rows], DOCUMENTS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.near_duplicates(rows).items()}


def test_bounds_keep_the_chance_of_a_miss_at_every_threshold():
    assert (minhash_dedup.least_matches(85), minhash_dedup.most_unequal_bits(85)) == (16, 28)
    for percent in range(40, 101):
        s, q = percent / 100, (1 - percent / 100) / 2
        fewer = sum(math.comb(32, k) * s**k * (1 - s) ** (32 - k) for k in range(minhash_dedup.least_matches(percent)))
        more = sum(math.comb(128, k) * q**k * (1 - q) ** (128 - k) for k in range(minhash_dedup.most_unequal_bits(percent) + 1, 129))
        assert fewer + more <= 1e-6
    with pytest.raises(ValueError):
        minhash_dedup.prefix_length(10)


@pytest.mark.parametrize("percent", [70, 80])
def test_near_duplicates_at_lower_thresholds(spark, percent):
    rng = random.Random(percent)
    base = words(rng, 220)
    texts = [" ".join(edited(rng, base, n)) for n in [0, 2, 3, 4, 5, 6, 8] * 6]
    rows = list(enumerate(texts))
    table = spark.createDataFrame([(i, t, "k", "w") for i, t in rows], DOCUMENTS)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(table, percent).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows, percent).items()}


def test_duplicates_with_odd_ids(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (5, text), (5, text), (3, text), (3, "other words entirely here now"), (None, None)]
    table = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCUMENTS)
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table).collect() if r["doc_id"])
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    kept = minhash_dedup.without_duplicates(table)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3]
    assert minhash_dedup.near_duplicates(table.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 50), (61, 60), (60, 61)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {60: 60, 61: 60}

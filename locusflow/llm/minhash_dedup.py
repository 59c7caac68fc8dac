"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's set is its distinct five-word shingles. Exact copies of a set are folded
first, by partial aggregation. Every remaining set has COORDINATES MinHash values; each
(coordinate, value) pair is a token with a posting list. Two sets at the similarity
threshold share at least ``least_matches`` tokens, so after ordering a set's tokens by
corpus frequency, rare first, they share one of their first COORDINATES less that number
plus one: only that prefix is posted. Collisions over all coordinates are counted on the
coordinates' low bits, which travel with the posting. Surviving pairs are confirmed on the
full sets.

Large groups never become all pairs. Neighbours in differently sorted posting lists are
confirmed first and joined into components; then only lists that still mix components are
read, and only pairs across components, one side outside the list's most frequent
component. A pair within a component cannot change the result. Shingles that a set of a
long list shares with no other thin that list before it is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.components import components
from locusflow.llm.text import give_back
from locusflow.llm.words import mix, slices, words_of
from locusflow.operators.durable import durable

SHINGLE = 5
#: Coordinates that become tokens, and those whose low bits form the sketch.
COORDINATES, SKETCHED = 32, 128
#: Chances that a pair exactly at the threshold fails the bound on equal coordinates, and that on sketch bits.
MISSED_MATCHES, MISSED_BITS = 6e-7, 1e-7
#: Counters of the token frequency sketch. It only orders tokens, so sharing a counter costs time, not pairs.
COUNTERS = 1 << 18
#: Before the exact pass: how far apart neighbours stand in a list, how many of a set are confirmed, and how often.
BESIDE, NEAREST, NEAR_ROUNDS = 16, 12, 1
#: Posting lists of so many rows get exact bounds before they are joined: shingles that no other set of such
#: lists has, and bit maps of so many 64-bit words.
LONG, MAP_WORDS = 50, 16
#: Bytes of text of the pairs that are confirmed at once, unless one pair has more.
CONFIRM_BYTES = 4 << 20
#: Up to so many ids of candidates are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(1, 1 << 62, SKETCHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 62, SKETCHED, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<int>, b1 bigint, b2 bigint"


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


@lru_cache
def least_matches(percent: int) -> int:
    """Equal coordinates of COORDINATES that a pair at the threshold has but with a chance of MISSED_MATCHES.

    At 85 percent these are 16 of 27.2 on average. No pair without an equal coordinate is
    ever found, so a threshold at which that happens more often is refused.
    """
    chance = _binomial(COORDINATES, percent / 100)
    fewest = [m for m in range(1, COORDINATES + 1) if sum(chance[:m]) <= MISSED_MATCHES]
    if not fewest:
        raise ValueError(f"{COORDINATES} coordinates find no pairs at {percent} percent surely")
    return max(fewest)


def prefix_length(percent: int) -> int:
    return COORDINATES - least_matches(percent) + 1


@lru_cache
def most_unequal_bits(percent: int) -> int:
    """Unequal bits of SKETCHED that a pair at the threshold exceeds with a chance of MISSED_BITS.

    Unequal coordinates still agree on one bit half of the time: at 85 percent a pair has
    9.6 unequal bits on average and 28 at most.
    """
    chance = _binomial(SKETCHED, (1 - percent / 100) / 2)
    return min(b for b in range(SKETCHED + 1) if sum(chance[b + 1 :]) <= MISSED_BITS)


def shingle_hashes(word_hash: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; of all its words if it has fewer."""
    n = len(word_hash)
    if n == 0:
        return word_hash
    size = min(SHINGLE, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = total + word_hash[j : n - size + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    for a, b in slices(texts):
        w = words_of(texts[a:b])
        for i in range(b - a):
            yield shingle_hashes(w.hash[w.first[i] : w.first[i + 1]])


def signature(hashes: np.ndarray) -> np.ndarray:
    best = np.full(SKETCHED, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(best, (hashes[at : at + 2048, None] * _FACTOR + _SHIFT).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def low_bits(sig: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit words of one bit for each of the (n, SKETCHED) values."""
    bits = (mix(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(sig), 2)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, rows = batch["text"].tolist(), []
        for hashes in sets_of(texts):
            if len(hashes):
                d1, d2 = (int(mix(hashes + np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (1, 1 << 40))
                sig = signature(hashes)
                b1, b2 = low_bits(sig[None])[0]
                rows.append((len(hashes), d1, d2, sig[:COORDINATES].view(np.int32), int(b1), int(b2)))
            else:
                rows.append((0, 0, 0, None, 0, 0))
        out = pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "sig", "b1", "b2"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out
        del batch, texts, rows, out
    give_back()


def _tokens(sig: pd.Series) -> np.ndarray:
    values = np.stack(sig.to_numpy()).astype(np.int32).view(np.uint32).astype(np.uint64)
    return values | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) % np.uint64(COUNTERS)).astype(np.int64)


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        if len(batch):
            counts += np.bincount(_counter(_tokens(batch["sig"])).ravel(), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"counter": at, "n": counts[at]})


def token_counts(sets: DataFrame) -> np.ndarray:
    """The frequency sketch over all sets: COUNTERS numbers whatever the input's size."""
    parts = sets.select("sig").mapInPandas(_count_tokens, "counter bigint, n bigint")
    summed = parts.groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[summed["counter"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.int64)
    return counts


def _rarest(sig: pd.Series, counts: np.ndarray, prefix: int) -> np.ndarray:
    tokens = np.sort(_tokens(sig), axis=1)
    rarest = np.argsort(counts[_counter(tokens)], axis=1, kind="stable")[:, :prefix]
    return np.take_along_axis(tokens, rarest, axis=1).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, tokens): every set's posted tokens."""
    prefix = prefix_length(percent)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def list_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "tokens": list(_rarest(batch["sig"], shared.value, prefix))})

    return sets.select("id", "sig").mapInPandas(list_tokens, "id bigint, tokens array<bigint>")


def postings(sets: DataFrame, counts: np.ndarray, percent: int, *carried: str) -> DataFrame:
    """(token, id, n, b1, b2, carried) for the ``prefix_length`` rarest tokens of every set."""
    prefix = prefix_length(percent)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    names = ["id", "n", "b1", "b2", *carried]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                tokens = _rarest(part["sig"], shared.value, prefix)
                yield pd.DataFrame(
                    {"token": tokens.ravel()} | {c: np.repeat(part[c].to_numpy(), prefix) for c in names}
                )

    schema = ", ".join(f"{c} bigint" for c in ["token", *names])
    return sets.select(*names, "sig").mapInPandas(post, schema)


def _unequal(x: str, y: str) -> Column:
    return F.expr(f"bit_count({x}.b1 ^ {y}.b1) + bit_count({x}.b2 ^ {y}.b2)")


def _may_link(x: str, y: str, percent: int) -> Column:
    sizes = F.expr(f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)")
    return sizes & (_unequal(x, y) <= most_unequal_bits(percent))


def _beside(percent: int):
    """Pairs of rows of different components, at most BESIDE places apart in a posting list, that may be linked."""
    most_unequal = most_unequal_bits(percent)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            held = batch if last is None else pd.concat([last, batch], ignore_index=True)
            last = held.iloc[-BESIDE:]
            token, ident, n, b1, b2, c = (held[k].to_numpy() for k in ("token", "id", "n", "b1", "b2", "c"))
            for step in range(1, min(BESIDE, len(held) - 1) + 1):
                unequal = np.bitwise_count(b1[:-step] ^ b1[step:]).astype(np.int64) + np.bitwise_count(b2[:-step] ^ b2[step:])
                near = (token[:-step] == token[step:]) & (c[:-step] != c[step:]) & (unequal <= most_unequal)
                near &= 100 * np.minimum(n[:-step], n[step:]) >= percent * np.maximum(n[:-step], n[step:])
                x, y = ident[:-step][near], ident[step:][near]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "unequal": unequal[near]})

    return pairs


def neighbours(posted: DataFrame, percent: int, round_: int) -> DataFrame:
    """For every set its NEAREST most similar neighbours among those beside it in posting lists.

    Sets of one component are no neighbours. Lists are ordered by the sketch bits, turned
    by a number that differs by token and round, and range-partitioned, so a long list is
    many tasks. Pairs across partitions are left to the exact pass.
    """
    turn = f"cast((token * 7 + {17 * round_}) % 61 AS INT)"
    turned = F.expr(f"shiftleft(b1, {turn}) | shiftrightunsigned(b1, 64 - {turn})")
    near = (
        posted.withColumn("turned", turned)
        .repartitionByRange("token", "turned", "id")
        .sortWithinPartitions("token", "turned", "id")
        .mapInPandas(_beside(percent), "a bigint, b bigint, unequal bigint")
        .distinct()
    )
    either = near.union(near.select("b", "a", "unequal"))
    best = Window.partitionBy("a").orderBy("unequal", "b")
    kept = either.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= NEAREST)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _set_bounds(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rare, m0, m1, ...): what bounds the shingles two sets of ``ids`` can share.

    ``rare`` counts a set's shingles that occur in no other set of ``ids``. The words m0, m1
    ... are a bit map of its shingles: a bit of x that y lacks is a shingle of x that y
    lacks. Ids that stand on several rows get none.
    """
    found = picked(texts, ids)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, held = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for a, b in slices(held):
                sets = list(sets_of(held[a:b]))
                owners = np.repeat(owner[a:b], [len(x) for x in sets])
                yield pd.DataFrame({"gram": np.concatenate(sets).view(np.int64), "id": owners})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.zeros((len(batch), 64 * MAP_WORDS), dtype=np.uint8)
            for i, hashes in enumerate(sets_of(batch["text"].tolist())):
                bits[i, (hashes >> np.uint64(20)) % np.uint64(64 * MAP_WORDS)] = 1
            words = np.packbits(bits, axis=1).view(np.int64).reshape(len(batch), MAP_WORDS)
            yield pd.DataFrame({"id": batch["doc_id"].to_numpy()} | {f"m{i}": words[:, i] for i in range(MAP_WORDS)})

    listed = found.mapInPandas(grams, "gram bigint, id bigint")
    alone = listed.groupBy("gram").agg(F.count("*").alias("held"), F.min("id").alias("id")).where("held = 1")
    rare = alone.groupBy("id").agg(F.count("*").alias("rare"))
    names = [f"m{i}" for i in range(MAP_WORDS)]
    mapped = found.mapInPandas(maps, ", ".join(f"{c} bigint" for c in ["id", *names]))
    mapped = mapped.groupBy("id").agg(F.count("*").alias("rows"), *(F.min(c).alias(c) for c in names)).where("rows = 1")
    return mapped.join(rare, "id", "left").select("id", F.coalesce("rare", F.lit(0)).alias("rare"), *names)


def _marked(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets with their component ``c``, which is the set itself where none is known."""
    return sets.join(labels, sets["id"] == labels["node"], "left").withColumn("c", F.coalesce("component", "id"))


def across_components(
    sets: DataFrame, counts: np.ndarray, labels: DataFrame, texts: DataFrame, percent: int
) -> DataFrame:
    """All pairs of a posting list that lie in different components and may be linked.

    In long lists two exact bounds come first. With ``rare`` shingles that no other set of
    such lists has, the intersection is at most n - rare and the union at least n + the
    other's rare; sets that cannot link with any go before the join. With bit maps, the
    intersection is at most n less the bits that the other lacks.
    """
    posted = postings(_marked(sets, labels), counts, percent, "c")
    per_component = posted.groupBy("token", "c").agg(F.count("*").alias("rows"))
    mixed = (
        per_component.groupBy("token")
        .agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.max_by("c", F.struct("rows", "c")).alias("main"))
        .where("parts > 1")
        .select("token", "main", (F.col("rows") >= LONG).alias("long"))
    )
    listed = durable(posted.join(mixed, "token"))
    long = listed.where("long")
    partner = F.expr("x.token = y.token AND x.c <> y.c") & _may_link("x", "y", percent)
    alive = long.where("c <> main").alias("x").join(long.alias("y"), partner, "left_semi").select("token").distinct()
    members = durable(long.join(alive, "token", "left_semi").select(F.col("id").alias("doc_id")).distinct())
    bounds = durable(_set_bounds(texts, members))
    columns = ["token", "id", "n", "b1", "b2", "c", "main"]
    once = F.expr("x.token = y.token AND x.c <> y.c AND (y.c = y.main OR x.id < y.id)")
    pair = F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")
    short = listed.where("NOT long").select(*columns)
    x, y = short.where("c <> main").alias("x"), short.alias("y")
    found = x.join(y, once & _may_link("x", "y", percent)).select(*pair)
    own = prefixes(sets.join(members, sets["id"] == members["doc_id"], "left_semi"), counts, percent).join(bounds, "id", "left")
    thinned = durable(
        long.select(*columns).join(own, "id")
        .where(F.col("rare").isNull() | (100 * (F.col("n") - F.col("rare")) >= percent * F.col("n")))
    )
    x, y = thinned.where("c <> main").alias("x"), thinned.alias("y")
    fits = f"100 * least(x.n - x.rare, y.n - y.rare) >= {percent} * greatest(x.n + y.rare, y.n + x.rare)"
    lacks = lambda s, t: " + ".join(f"bit_count({s}.m{i} & ~{t}.m{i})" for i in range(MAP_WORDS))
    share = f"least(x.n - ({lacks('x', 'y')}), y.n - ({lacks('y', 'x')}))"
    fits = F.expr(f"x.rare IS NULL OR y.rare IS NULL OR ({fits} AND {100 + percent} * {share} >= {percent} * (x.n + y.n))")
    # A pair of long lists is taken from its first common list alone.
    first = F.expr("array_min(array_intersect(x.tokens, y.tokens)) = x.token")
    found = found.union(x.join(y, once & _may_link("x", "y", percent) & fits & first).select(*pair))
    return found.distinct()


def _confirm(percent: int):
    """Keeps the pairs whose sets reach the threshold, a few megabytes of text at a time."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(c) for c in ("text_a", "text_b")]
            size = np.cumsum(sum(pc.binary_length(x).to_numpy(zero_copy_only=False) for x in both))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CONFIRM_BYTES, side="right")))
                first, second = (x.slice(at, to - at).to_pylist() for x in both)
                texts = list(dict.fromkeys([*first, *second]))
                sets = dict(zip(texts, sets_of(texts)))
                keep = [_linked(sets[s], sets[t], percent) for s, t in zip(first, second)]
                yield batch.slice(at, to - at).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                at = to
            del batch, both, first, second, texts, sets
        give_back()

    return confirm


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def picked(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``; few ids travel to the documents, many meet them in a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")


def confirmed(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = durable(pairs)
    ids = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = picked(documents, ids)
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(_confirm(percent), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A link at ``percent`` exactly is missed with a chance of at most MISSED_MATCHES +
    MISSED_BITS, a closer one with less. A document without words (null or blank text) has an empty set and is linked with
    nothing. Rows that repeat a ``doc_id`` with another text are versions of one document
    and share its component. A row without ``doc_id`` takes part as no document: its
    component is null and it is kept. Other columns are ignored; an empty table gives none.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    signed = durable(documents.mapInPandas(_sign, SIGNED))
    keys = ["d1", "d2", "n_shingles"]
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = durable(
        real.groupBy(*keys).agg(
            F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("b1").alias("b1"), F.first("b2").alias("b2")
        ).withColumnRenamed("n_shingles", "n")
    )
    counts = token_counts(sets)
    texts = documents.where(F.col("doc_id").isNotNull())
    labels, ends = None, None
    for round_ in range(NEAR_ROUNDS):
        marked = sets.withColumn("c", F.col("id")) if labels is None else _marked(sets, labels)
        links = confirmed(neighbours(postings(marked, counts, percent, "c"), percent, round_), texts, percent)
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = durable(components(edges if ends is None else edges.union(ends)))
        ends = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    more = confirmed(across_components(sets, counts, labels, texts, percent), texts, percent)
    versions = real.join(sets.withColumnRenamed("n", "n_shingles"), keys).select(
        F.col("doc_id").alias("u"), F.col("id").alias("v")
    )
    edges = ends.union(more.select(F.col("a").alias("u"), F.col("b").alias("v"))).union(versions)
    reached = components(edges)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.join(reached, signed["doc_id"] == reached["node"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The kept document of every component, with all its columns; of rows that share a ``doc_id``, one."""
    found = durable(near_duplicates(documents, percent).where(F.col("doc_id").isNotNull()))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    repeated = durable(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    kept = documents.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again)

"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame functions only.

A benchmark window is a set of three-word shingles that a contaminated document contains
whole, so the rarest one is a sufficient prefix: shingles are ordered by their count over
all documents and every window is posted under its rarest. A document's shingles probe
that table. A hit gives the only start the window can have; starts outside the document
fall to the length and positional bounds, the rest are compared word by word.

The prefix table is broadcast only when its measured size is below ``BROADCAST_BYTES``;
beyond that the same join is a shuffle that carries positions instead of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.text import ascii_lower
from locusflow.operators.durable import durable

WINDOW, SHINGLE = 10, 3
BROADCAST_BYTES = 16 << 20
#: Runs of bytes that are no word characters, in lower-cased text and in text that keeps A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_BUT_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """Lower case character by character. Texts equal after lower-casing A-Z are equal after folding."""
    return F.lower(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("ς"), F.lit("σ")))


def _shingles(words: Column, size: int) -> Column:
    """At each word the hash of the next ``size`` words; the last places hash fewer and match nothing by length."""
    following = lambda w, i: [w, *(F.get(words, i + j) for j in range(1, size))]
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(size), *following(w, i)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row per distinct window: window (text), length, words folded, items (ids as text)."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("w"))
    return (
        windows.groupBy("w")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select(
            F.array_join("w", " ").alias("window"), F.size("w").alias("length"), "items",
            F.transform("w", fold).alias("folded"),
        )
    )


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, ..., size, offset, shingle): every full shingle of every window."""
    out = None
    for size in range(1, SHINGLE + 1):
        longest = F.col("length") >= size if size == SHINGLE else F.col("length") == size
        part = (
            windows.where(longest)
            .select("*", F.posexplode(_shingles(F.col("folded"), size)).alias("offset", "shingle"))
            .where(F.col("offset") <= F.col("length") - size)
            .withColumn("size", F.lit(size))
        )
        out = part if out is None else out.unionByName(part)
    return out.drop("folded")


def _documents(documents: DataFrame) -> DataFrame:
    """(doc_id, key, words, exact, n_words). ``exact`` keeps the case, where folding changed more than A-Z."""
    text = F.coalesce(F.col("text"), F.lit(""))
    changed = (F.char_length("t") != F.octet_length("t")) & (fold(F.col("t")) != ascii_lower(F.col("t")))
    empties = F.expr("int(words[0] = '') + int(size(words) > 1 AND words[size(words) - 1] = '')")
    return (
        documents.select(F.col("doc_id"), text.alias("t"))
        .select(
            "doc_id", F.xxhash64("t").alias("key"), F.split(fold(F.col("t")), SEPARATORS).alias("words"),
            F.when(changed, F.split("t", SEPARATORS_BUT_UPPER)).alias("exact"),
        )
        .withColumn("n_words", (F.size("words") - empties).cast("long"))
    )


def _places(documents: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """One row per place and size with its shingle, led by one row per document with ``place`` 0.

    The arrays are never empty; the outer form only keeps the planner from deriving a filter
    on their size, which would split the text again for every word.
    """
    shingles = F.concat(F.array(F.lit(None).cast("long")), *(_shingles(F.col("words"), s) for s in sizes))
    total = F.size("words")
    return (
        documents.withColumn("_s", shingles)
        .select("doc_id", "key", "n_words", *columns, total.alias("total"), F.posexplode_outer("_s").alias("place", "shingle"))
        .withColumn("at", (F.col("place") - 1) % F.col("total"))
    )


def _same_words() -> Column:
    read = lambda words: F.array_join(F.slice(words, F.col("start") + 1, F.col("length")), " ")
    return F.when(F.col("exact").isNull(), read("words")).otherwise(ascii_lower(read("exact"))) == F.col("window")


def _fits() -> Column:
    return (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("total"))


def rarest(shingles: DataFrame, documents: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Every window with its shingle of the lowest count over all documents; ties go to the first place."""
    known = shingles.select("shingle").distinct()
    places = _places(documents, sizes)
    counts = places.join(F.broadcast(known) if small else known, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle", "items", "length", "size")
    return (
        shingles.join(counts, "shingle", "left")
        .groupBy("window")
        .agg(F.min(order).alias("m"))
        .select("window", "m.offset", "m.shingle", "m.items", "m.length")
    )


def _bytes(df: DataFrame) -> int:
    """Measured size of a table of windows."""
    row = F.lit(64) + F.octet_length("window") + 8 * F.size("items")
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key (hash of the text).

    Null and empty texts have no words and are clean; items without words or id have no
    windows; items repeat freely. Equal rows give equal results, one each. Windows that
    overlap hit a word once. Without benchmark items nothing is hit. Other columns are ignored.
    """
    shingles = durable(window_shingles(benchmark_windows(benchmark)))
    sizes = [r[0] for r in shingles.select("size").distinct().collect()] or [SHINGLE]
    small = _bytes(shingles) <= broadcast_bytes
    docs = _documents(documents)
    prefix = durable(rarest(shingles, docs, sizes, small))
    start = (F.col("at") - F.col("offset")).alias("start")
    if small:
        probed = _places(docs, sizes, "words", "exact").join(F.broadcast(prefix), "shingle", "left")
        found = probed.select("*", start).where(
            (F.col("place") == 0) | (F.col("window").isNotNull() & _fits() & _same_words())
        )
    else:
        found = _found_by_shuffle(docs, prefix, sizes, start)
    hit = F.when(F.col("place") > 0, F.struct("start", F.col("length").alias("length")))
    merged = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(-1).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(
            F.greatest(acc["upto"], h["start"] + h["length"]).alias("upto"),
            (acc["n"] + F.greatest(h["start"] + h["length"] - F.greatest(acc["upto"], h["start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return (
        found.groupBy("doc_id", "key", "n_words")
        .agg(
            F.collect_set(hit).alias("hits"),
            F.collect_set(F.when(F.col("place") > 0, F.col("items"))).alias("lists"),
            F.sum(F.when(F.col("place") == 0, 1)).cast("int").alias("rows"),
        )
        .withColumn("items", F.array_sort(F.array_distinct(F.flatten("lists"))))
        .withColumn("n_hit", merged)
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"), "key", F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("_row"),
        )
        .drop("_row")
    )


def _found_by_shuffle(docs: DataFrame, prefix: DataFrame, sizes: list[int], start: Column) -> DataFrame:
    """The same rows for a benchmark that is too large to broadcast: positions are shuffled, words follow hits only."""
    keys = ["doc_id", "key"]
    names = [*keys, "n_words", "place", "start", "length", "items"]
    lead = docs.select(*keys, "n_words", F.lit(0).alias("place"), *(F.lit(None).cast(t).alias(c) for c, t in (
        ("start", "int"), ("length", "int"), ("items", "array<string>"))))
    hits = _places(docs, sizes).join(prefix, "shingle").select("*", start).where(_fits())
    hits = hits.select(*keys, "place", "start", "length", "items", "window").distinct()
    texts = docs.select("doc_id", "key", "n_words", "words", "exact").dropDuplicates(keys).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key"))
    checked = texts.join(hits.alias("h"), same).drop(F.col("h.doc_id")).drop(F.col("h.key")).where(_same_words())
    return lead.union(checked.select(*names))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    hit = contaminated(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), "key").distinct()
    same = documents["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col("key"))
    return documents.join(hit, same, "left_anti")

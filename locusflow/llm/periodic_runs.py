"""Maximal periodic runs of words, by recompression.

The words of a few documents become one sequence of numbers with a separator of its own
after each document. Rounds of block compression (a maximal block of one symbol becomes
one symbol) and pair compression (the symbols are split into left and right ones, and
every left-right pair becomes one symbol) turn it into a run-length grammar: a list of
levels, each with its symbols and their places in the level above. Equal stretches are
compressed alike but for a few symbols at their ends, so the longest common extension of
two places climbs the levels while both agree and comes down where they differ: a few
steps a level, a number of levels that is logarithmic in the document, and no suffix array.

A run of period p that is at least ``times`` periods and ``least`` words long has
x[i] = x[i + p] on a stretch of max((times - 1) * p, least - p) places. Such a stretch holds a
multiple of its length, so for every p only the grid of those multiples is tried: a
harmonic sum of places. Extensions to both sides give the run exactly.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.functions.binding import let
from locusflow.llm.text import with_columns
from locusflow.llm.words import mix, slices

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: A grammar is high enough when no document has more symbols; as many are compared one by one.
FEW_SYMBOLS = 8
#: Grid places that are tried at once.
GRID_CHUNK = 1 << 20

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False
)


class Level(NamedTuple):
    """Symbols of one level; the parent of each, and each parent's first child, with an end mark."""

    symbol: np.ndarray
    blocks: bool  # whether the level above compresses blocks, else pairs
    up: np.ndarray
    first: np.ndarray


def _named(symbol: np.ndarray, joined: np.ndarray, second, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Parents where a symbol is ``joined`` to its predecessor: (up, first, symbols, names used).

    A parent of one symbol keeps its name; the others are named by their first symbol and
    ``second``, what distinguishes them besides it.
    """
    begins = np.flatnonzero(~joined)
    first = np.append(begins, len(symbol))
    parents, several = symbol[begins], np.diff(first) > 1
    if several.any():
        extra = second(begins, np.diff(first))[several].astype(np.int64)
        keys = parents[several] * (int(extra.max()) + 1) + extra
        rules, named = np.unique(keys, return_inverse=True)
        parents[several] = names + named
        names += len(rules)
    return np.cumsum(~joined) - 1, first, parents, names


def grammar(symbol: np.ndarray) -> list[Level]:
    """Levels from the sequence up. Negative symbols are separators, each used once, also first and last."""
    levels, names, rng = [], int(symbol.max(initial=0)) + 1, np.random.default_rng(11)
    none = np.zeros(0, dtype=np.int64)
    while True:
        joined = np.zeros(len(symbol), dtype=bool)
        joined[1:] = symbol[1:] == symbol[:-1]
        up, first, parents, names = _named(symbol, joined, lambda at, size: size, names)
        levels.append(Level(symbol, True, up, first))
        symbol = parents
        if np.diff(np.flatnonzero(symbol < 0)).max(initial=0) <= FEW_SYMBOLS + 1:
            return [*levels, Level(symbol, True, none, none)]
        salt = rng.integers(1 << 63, dtype=np.uint64)
        right = mix(symbol.astype(np.uint64) + salt) & np.uint64(1) == 1
        joined = np.zeros(len(symbol), dtype=bool)
        joined[1:] = ~right[:-1] & right[1:] & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
        held = symbol
        up, first, parents, names = _named(symbol, joined, lambda at, size: held[np.minimum(at + 1, len(held) - 1)], names)
        levels.append(Level(symbol, False, up, first))
        symbol = parents


def _rest(level: Level, at: np.ndarray, way: int) -> np.ndarray:
    """Symbols of the parent from here on, this one included."""
    parent = level.up[at]
    return level.first[parent + 1] - at if way > 0 else at - level.first[parent] + 1


def _whole(level: Level, at: np.ndarray, way: int) -> np.ndarray:
    """Whether the parent begins here, seen in the direction."""
    parent = level.up[at]
    return level.first[parent] == at if way > 0 else level.first[parent + 1] - 1 == at


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
    """How many symbols from the places i and j on (i != j) are equal, to the right (1) or left (-1)."""
    began, i, j = i, i.copy(), j.copy()
    live, stopped = np.arange(len(i)), []
    for level in levels[:-1]:
        a, b = i[live], j[live]
        same = level.symbol[a] == level.symbol[b]
        if level.blocks:
            left_a, left_b = _rest(level, a, way), _rest(level, b, way)
            goes_on = same & (left_a == left_b)
            matched = np.where(same, np.minimum(left_a, left_b), 0)
            i[live] = np.where(goes_on, level.up[a] + way, a + way * matched)
            j[live] = np.where(goes_on, level.up[b] + way, b + way * matched)
        else:
            whole = _whole(level, a, way) & _whole(level, b, way)
            goes_on = whole | same
            last = len(level.symbol) - 1
            i[live] = np.where(whole, level.up[a], np.where(same, level.up[np.clip(a + way, 0, last)], a))
            j[live] = np.where(whole, level.up[b], np.where(same, level.up[np.clip(b + way, 0, last)], b))
        stopped.append(live[~goes_on])
        live = live[goes_on]
    top, going = levels[-1].symbol, live
    while len(going):
        going = going[top[i[going]] == top[j[going]]]
        i[going] += way
        j[going] += way
    for level, more in zip(levels[-2::-1], stopped[::-1]):
        for at in (i, j):
            at[live] = level.first[at[live]] if way > 0 else level.first[at[live] + 1] - 1
        a, b = i[live], j[live]
        matched = (level.symbol[a] == level.symbol[b]).astype(np.int64)
        if level.blocks:
            matched *= np.minimum(_rest(level, a, way), _rest(level, b, way))
        i[live] += way * matched
        j[live] += way * matched
        live = np.concatenate([live, more])
    return way * (i - began)


def _grid(begin: np.ndarray, size: np.ndarray, least: int, times: int):
    """Chunks of (place, period) of all documents' harmonic grids."""
    periods = np.where(size >= least, size // times, 0)
    owner = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum((times - 1) * period, least - period)
    count = (size[owner] - period + step - 1) // step
    ends = np.cumsum(count)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID_CHUNK, side="right")))
        own, n = np.arange(at, to), count[at:to]
        own = np.repeat(own, n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        yield begin[owner[own]] + k * step[own], period[own]
        at = to


def find_runs(
    symbol: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the documents symbol[begin : begin + size], by start, then period."""
    found, levels = [np.zeros((3, 0), dtype=np.int64)], None
    for place, period in _grid(begin, size, least, times):
        equal = symbol[place] == symbol[place + period]
        place, period = place[equal], period[equal]
        if not len(place):
            continue
        levels = grammar(symbol) if levels is None else levels
        after = extensions(levels, place, place + period, 1)
        before = extensions(levels, place - 1, place + period - 1, -1)
        length = before + period + after
        enough = length >= np.maximum(least, times * period)
        found.append(np.stack([place - before, length, period])[:, enough])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # Multiples of a run's period give the same stretch: the smallest stays.
    new = np.ones(len(start), dtype=bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(texts: list[str | None], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> tuple[list, list]:
    """Every text's runs and its collapsed words."""
    runs, collapsed = [], []
    for a, b in slices(texts):
        names: dict[bytes, int] = {}
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(size + 1) - size
        symbol = np.empty(int((size + 1).sum()) + 1, dtype=np.int64)
        symbol[0] = -1
        for i, own in enumerate(words):
            symbol[begin[i] : begin[i] + size[i]] = [names.setdefault(w, len(names)) for w in own]
            symbol[begin[i] + size[i]] = -2 - i
        start, length, period = find_runs(symbol, begin, size, least, times)
        cut = np.zeros(len(symbol) + 1, dtype=np.int64)
        np.add.at(cut, start + period, 1)
        np.add.at(cut, start + length, -1)
        kept = np.cumsum(cut)[:-1] == 0
        first = np.searchsorted(start, np.append(begin, len(symbol)))
        for i, own in enumerate(words):
            mine = slice(first[i], first[i + 1])
            runs.append(list(zip((start[mine] - begin[i]).tolist(), length[mine].tolist(), period[mine].tolist())))
            if runs[-1]:
                own = [w for w, keep in zip(own, kept[begin[i] : begin[i] + size[i]].tolist()) if keep]
            collapsed.append(None if texts[a + i] is None else b" ".join(own).decode("utf-8", "surrogatepass"))
    return runs, collapsed


def with_runs(documents: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """The documents with ``runs`` (start, length, period; in words from 0) and ``collapsed``.

    A run is a stretch of at least ``least`` words and ``times`` (2 at least) smallest periods that no
    neighbouring word extends. ``collapsed`` has the words left when each run keeps only its
    first period, joined by single spaces. A null text has no runs and null; an empty or blank
    one has no runs and the empty text. Words are runs of characters other than ASCII white
    space, compared exactly. All rows and other columns stay, repeated ones too; columns
    named ``runs`` or ``collapsed`` are replaced. An empty table gives none. A document is
    handled by one task, in memory proportional to its length.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    columns = {"runs": RUNS, "collapsed": T.StringType()}
    return with_columns(documents, lambda: lambda texts: runs_of(texts, least, times), columns)


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where one document of ten, by the checksum of its id, repeats from some word on.

    With h = crc32(decimal doc_id), g = h div 10 and n words: if h ends in 0, every word from
    a = g % n on is repeated with period 1 + (n - a) div (3 + g % 8), up to the n-th word.
    A null id or text plants nothing.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.expr("_h div 10")
        return let(F.struct(F.pmod(g, n).cast("int").alias("a"), n.alias("n"), w.alias("w")), lambda s: let(
            F.struct((F.floor((s["n"] - s["a"]) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int").alias("p"), s.alias("s")), _cycle
        ))

    def _cycle(v: Column) -> Column:
        a, p, n, w = v["s"]["a"], v["p"], v["s"]["n"], v["s"]["w"]
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")

    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))
    return documents.withColumn("_h", checksum).select(
        "doc_id", F.when(F.col("_h") % 10 == 0, changed).otherwise(F.col("text")).alias("text")
    )


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period, and digests of all runs and of the kept words."""
    fields = ("start", "length", "period")
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in fields))
    better = lambda best, r: F.when(
        best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in fields))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", *(f"best.{c}" for c in fields),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

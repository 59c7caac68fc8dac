"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is a word with its boundaries, at most WINDOW bytes long. It is written as the
32-bit codes of its byte trigrams, which nothing but a dictionary match can compress, so
its compressed length says how much of it the dictionary's text contains. A window's gain
is the bytes that the toxic dictionary saves over the ordinary one. A logistic curve over
a text's gains, calibrated on documents that neither dictionary has seen, gives the score.

Most words of a toxic document are ordinary. The toxic dictionary is therefore trained on
those windows of toxic documents that the ordinary dictionary hardly compresses and that
recur in toxic documents more often than in ordinary ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.logistic import fit_logistic, prior_shift, score_logistic
from locusflow.llm.samples import labelled_texts
from locusflow.llm.text import bucket
from locusflow.llm.words import range_hash, running_hash, slices, words_of

WINDOW = 48
#: Bytes by which a window that is kept as it is exceeds its own length.
FRAME = 9
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT = 65_536, 16_384, 32
#: A toxic training window follows different windows in toxic documents for at least this share of them,
#: and so many times as often as in ordinary ones. Copies of a document or passage count once.
LEAST_SHARE, LEAST_RATIO = 0.01, 3.0
#: The ordinary dictionary leaves so much of its length.
MOSTLY_NEW = 0.5
#: A gain that random likeness rarely reaches, and one that it reaches less often than toxic text.
CLEAR_GAIN, SOME_GAIN = 11, 6
FEATURES = 7
LEVEL = 3
SAMPLE_EACH, SLICE_CHARS, CACHED_WORDS = 1200, 1_000_000, 500_000
FOLDS = 4
THRESHOLD = 0.3
RESULT = "doc_id bigint, held_out boolean, score double, predicted int"


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def _compressor(data: bytes):
    """Compressed length of a window under a dictionary; without one every window keeps its length."""
    if not data:
        return lambda window: len(window) + FRAME
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    own = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return lambda window: len(own.compress(window))


def _windows(texts: list[str | None]):
    """(words, codes, start, end, first): windows as ranges of trigram codes; text i has first[i] : first[i + 1]."""
    w = words_of(["", *texts])  # a separator stands before the first word and behind the last
    h = running_hash(w.data) if len(w.data) else np.zeros(1, dtype=np.uint64)
    places = np.arange(max(len(w.data) - 2, 0))
    codes = (range_hash(h, places, places + 3) >> np.uint64(32)).astype(">u4")
    pieces = np.maximum(-(-(w.end - w.start) // WINDOW), 1)
    of = np.repeat(np.arange(len(w.start)), pieces)
    part = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = w.start[of] - 1 + part * WINDOW
    end = np.minimum(start + WINDOW, w.end[of] - 1)
    end = np.where(part == pieces[of] - 1, w.end[of] - 1, end)
    key = np.where(pieces[of] == 1, w.hash[of], range_hash(h, start, end + 2))
    first = np.concatenate([[0], np.cumsum(pieces)])[w.first[1:]]
    return key, codes, start, end, first


class Gains:
    """Gains of windows under a model's dictionaries, remembering a bounded number of them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.known: dict[int, int] = {}

    def gain(self, window: bytes) -> int:
        toxic = self.toxic(window)
        if toxic >= len(window) + FRAME:
            return 0  # nothing saved, whatever the other dictionary says
        return max(0, self.ordinary(window) - toxic)

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The gains of each text's windows."""
        for a, b in slices(texts, SLICE_CHARS):
            key, codes, start, end, first = _windows(texts[a:b])
            distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            known, out = self.known, np.zeros(len(distinct), dtype=np.int64)
            for i, (k, s, e) in enumerate(zip(distinct.tolist(), start[at].tolist(), end[at].tolist())):
                g = known.get(k)
                if g is None:
                    g = known[k] = self.gain(codes[s:e].tobytes())
                out[i] = g
            gains = out[back]
            for i in range(b - a):
                yield gains[first[i] : first[i + 1]]


def summary(gains: np.ndarray) -> list[float]:
    """What the score depends on: how often, how far and how densely windows pass the clear gain."""
    over = np.maximum(gains - CLEAR_GAIN + 1, 0)
    some = np.maximum(gains - SOME_GAIN + 1, 0)
    n = max(len(gains), 1)
    return [
        np.log1p(1000 * (some > 0).sum() / n), np.log1p(100 * some.sum() / n),
        np.log1p(over.sum()), np.log1p(1000 * (over > 0).sum() / n), np.log1p(100 * over.sum() / n),
        gains.max(initial=0) / 10, np.log1p((over > 0).sum()),
    ]


def _document_windows(texts: list[str]) -> list[set[tuple[bytes, bytes]]]:
    """For each text its distinct (window before, window) pairs."""
    out = []
    for a, b in slices(texts, SLICE_CHARS):
        _, codes, start, end, first = _windows(texts[a:b])
        for i in range(b - a):
            own = [codes[start[j] : end[j]].tobytes() for j in range(first[i], first[i + 1])]
            out.append(set(zip([b"", *own[:-1]], own)))
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of too few samples there is none."""
    size = min(size, sum(map(len, samples)) // 2)
    if size < 1024 or len(samples) < 8:
        return b""
    return zstandard.train_dictionary(
        size, samples, k=SEGMENT, d=8, f=20, accel=1, split_point=1.0, steps=1, level=LEVEL, dict_id=1
    ).as_bytes()


def _dictionaries(sample: pd.DataFrame) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled texts."""
    toxic = _document_windows(sample[sample["label"] == 1]["text"].tolist())
    plain = _document_windows(sample[sample["label"] == 0]["text"].tolist())
    ordinary = _trained([x for d in plain for x in sorted({x for _, x in d})], ORDINARY_BYTES)
    length = _compressor(ordinary)
    toxic_count, plain_count = (Counter(x for _, x in set().union(*documents)) for documents in (toxic, plain))
    share = lambda count, documents: count / max(len(documents), 1)
    special = {
        x for x, n in toxic_count.items()
        if n >= 3 and share(n, toxic) >= max(LEAST_SHARE, LEAST_RATIO * share(plain_count[x], plain))
        and length(x) - FRAME >= MOSTLY_NEW * len(x)
    }
    return ordinary, _trained([x for d in toxic for x in sorted({x for _, x in d} & special)], TOXIC_BYTES)


def fit(sample: pd.DataFrame, toxic_share: float | None = None) -> Model:
    """Dictionaries from all of the sample; the curve from gains of each fold under dictionaries of the others.

    ``toxic_share`` is the share of label 1 among all labelled rows, which the sample evens out.
    """
    fold = sample.groupby("label").cumcount() % FOLDS
    x, y = [np.zeros((0, FEATURES))], [np.zeros(0)]
    for part in range(FOLDS):
        rest = sample[fold == part]
        gains = Gains(*_dictionaries(sample[fold != part]))
        x.append(np.array([summary(g) for g in gains.texts(rest["text"].tolist())]).reshape(len(rest), FEATURES))
        y.append(rest["label"].to_numpy(dtype=float))
    weights = fit_logistic(np.concatenate(x), np.concatenate(y))
    weights[-1] += prior_shift(sample["label"], toxic_share)
    return Model(*_dictionaries(sample), weights)


def training_model(documents: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Model:
    """Fitted on labelled rows whose bucket is not 2, at most ``each`` of a label."""
    known = labels.where(bucket(F.col("doc_id"), 4) != 2).where(F.col("toxic").isin(0, 1))
    share = known.agg(F.avg("toxic")).first()[0]
    return fit(labelled_texts(documents, known.select("doc_id", F.col("toxic").alias("label")), each), share)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= THRESHOLD).

    Null, empty and wordless texts have no windows and get the score of a text without
    gains. Every row is scored from its own text; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long"), "text", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        gains = Gains(own.ordinary, own.toxic)
        for batch in batches:
            x = np.array([summary(g) for g in gains.texts(batch["text"].tolist())]).reshape(len(batch), FEATURES)
            out = batch[["doc_id", "held_out"]].copy()
            out["score"] = score_logistic(own.weights, x)
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            yield out

    return rows.mapInPandas(score, RESULT)

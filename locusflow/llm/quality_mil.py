"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: statistics of
its characters, words and repeats, and hashed word shapes, pass through a learned layer.
Gated attention weighs the passages, the weighted mean is the document's representation,
and a logistic unit scores it. Only document labels are known when it is fitted, by
gradient steps through all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.logistic import prior_shift, sigmoid
from locusflow.llm.samples import labelled_texts
from locusflow.llm.text import bucket, with_columns
from locusflow.llm.words import LOWER, mix, slices, words_of

PASSAGE = 48
HIDDEN, GATE = 24, 12
#: Classes of bytes that are counted in every passage.
_CLASSES = np.zeros(256, dtype=np.int8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", "#$%&*", "<>{}[]\\/=+_@^~`", "\n"), 1):
    for _c in _chars:
        _CLASSES[ord(_c)] = _i
_CLASSES[0x80:] = 9
CLASSES = 10
SHAPES = 16
FEATURES = CLASSES + 10 + SHAPES
SAMPLE_EACH, SLICE_CHARS = 900, 1_000_000
THRESHOLD = 0.3
RESULT = "doc_id bigint, held_out boolean, score double, predicted int, n_passages bigint"


class Mil(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # (FEATURES + 1, HIDDEN)
    value: np.ndarray  # (HIDDEN + 1, GATE), tanh branch
    gate: np.ndarray  # (HIDDEN + 1, GATE), sigmoid branch
    attend: np.ndarray  # (GATE,)
    out: np.ndarray  # (HIDDEN + 1,)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first): text i has passages first[i] : first[i + 1]; a wordless text has one, all 0."""
    w = words_of(texts, lower=False)
    n_words = np.diff(w.first)
    count = np.maximum(-(-n_words // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros((first[-1], FEATURES))
    if not len(w.start):
        return x, first
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(text)) - w.first[text]
    own = first[text] + place // PASSAGE
    size = np.bincount(own, minlength=first[-1]).astype(float)
    safe = np.maximum(size, 1)
    total = lambda values: np.bincount(own, weights=values, minlength=first[-1])

    kind = _CLASSES[w.data]
    length = (w.end - w.start).astype(float)
    chars = np.maximum(total(length), 1)
    for c in range(1, CLASSES):
        upto = np.concatenate([[0], np.cumsum(kind == c)])
        after = np.append(w.start[1:], len(w.data))
        x[:, c] = total(upto[np.maximum(after, w.end)] - upto[w.start]) / chars
    x[:, 0] = np.log1p(size)

    base = CLASSES
    x[:, base] = total(length) / safe
    x[:, base + 1] = np.sqrt(np.maximum(total(length**2) / safe - x[:, base] ** 2, 0))
    same = np.zeros(len(text))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    x[:, base + 2] = total(same) / safe
    pair = own.astype(np.uint64) << np.uint64(40) ^ (w.hash >> np.uint64(24))
    order = np.argsort(pair, kind="stable")
    fresh = np.ones(len(pair))
    fresh[order[1:]] = pair[order[1:]] != pair[order[:-1]]
    x[:, base + 3] = total(fresh) / safe
    last, head = w.data[w.end - 1], w.data[w.start]
    x[:, base + 4] = total(_CLASSES[last] == 3) / safe
    x[:, base + 5] = total((_CLASSES[last] >= 4) & (_CLASSES[last] <= 7)) / safe
    x[:, base + 6] = total(_CLASSES[head] == 1) / safe
    x[:, base + 7] = total(length == 1) / safe
    x[:, base + 8] = total(length > 20) / safe
    x[:, base + 9] = np.log1p(n_words[np.repeat(np.arange(len(count)), count)]) / 10
    shape = mix(LOWER[last].astype(np.uint64) * np.uint64(64) + np.minimum(length, 12).astype(np.uint64)) % np.uint64(SHAPES)
    for s in range(SHAPES):
        x[:, base + 10 + s] = total(shape == s) / safe
    return x, first


def _plus_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def forward(m: Mil, x: np.ndarray, first: np.ndarray):
    z = _plus_one((x - m.mean) / m.scale)
    h = _plus_one(np.tanh(z @ m.encode))
    v, g = np.tanh(h @ m.value), sigmoid(h @ m.gate)
    a = (v * g) @ m.attend
    begin, count = first[:-1], np.diff(first)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, begin), count))
    a /= np.repeat(np.add.reduceat(a, begin), count)
    bag = np.add.reduceat(a[:, None] * h, begin, axis=0)
    return z, h, v, g, a, bag, sigmoid(bag @ m.out)


def fit(sample: pd.DataFrame, good_share: float | None = None, epochs: int = 60, rate: float = 0.02, decay: float = 1e-3) -> Mil:
    """Adam over whole bags; both labels weigh the same, and the constant then gets the labels' real share."""
    rng = np.random.default_rng(11)
    y_all = sample["label"].to_numpy(dtype=float)
    parts, firsts = [], [np.zeros(1, dtype=np.int64)]
    texts = sample["text"].tolist()
    for a, b in slices(texts, SLICE_CHARS):
        x, first = passages(texts[a:b])
        firsts.append(first[1:] + firsts[-1][-1])
        parts.append(x)
    x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
    first = np.concatenate(firsts)
    scale = x.std(axis=0) if len(x) else np.ones(FEATURES)
    p = {
        "encode": rng.normal(size=(FEATURES + 1, HIDDEN)) / np.sqrt(FEATURES),
        "value": rng.normal(size=(HIDDEN + 1, GATE)) / np.sqrt(HIDDEN),
        "gate": rng.normal(size=(HIDDEN + 1, GATE)) / np.sqrt(HIDDEN),
        "attend": rng.normal(size=GATE) / np.sqrt(GATE), "out": np.zeros(HIDDEN + 1),
    }
    m = Mil(x.mean(axis=0) if len(x) else np.zeros(FEATURES), np.where(scale > 1e-9, scale, 1.0), **p)
    if len(np.unique(y_all)) < 2:
        return m
    share = y_all.mean()
    weight = np.where(y_all == 1, 0.5 / share, 0.5 / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y_all))
        for at in np.array_split(order, max(1, len(order) // 128)):
            count = np.diff(first)[at]
            begin = np.concatenate([[0], np.cumsum(count)])
            rows = np.repeat(first[at] - begin[:-1], count) + np.arange(begin[-1])
            z, h, v, g, a, bag, score = forward(m, x[rows], begin)
            d_out = ((score - y_all[at]) * weight[at]) / len(at)
            d_bag = d_out[:, None] * m.out
            d_bag_rows = np.repeat(d_bag, count, axis=0)
            d_a = (d_bag_rows * h).sum(axis=1)
            d_a = a * (d_a - np.repeat(np.add.reduceat(a * d_a, begin[:-1]), count))
            d_vg = d_a[:, None] * m.attend
            d_v, d_g = d_vg * g * (1 - v * v), d_vg * v * g * (1 - g)
            d_h = a[:, None] * d_bag_rows + d_v @ m.value.T + d_g @ m.gate.T
            d_z = d_h[:, :-1] * (1 - h[:, :-1] ** 2)
            grads = {
                "encode": z.T @ d_z, "value": h.T @ d_v, "gate": h.T @ d_g,
                "attend": (v * g).T @ d_a, "out": bag.T @ d_out,
            }
            step += 1
            for k, gradient in grads.items():
                gradient = gradient + decay * p[k]
                one, two = moments[k]
                one += 0.1 * (gradient - one)
                two += 0.001 * (gradient**2 - two)
                p[k] -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    m.out[-1] += prior_shift([0, 1], good_share)
    return m


def training_model(documents: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Mil:
    """Fitted on labelled rows whose bucket is not 0, at most ``each`` of a label."""
    known = labels.where(bucket(F.col("doc_id"), 5) != 0).where(F.col("quality").isin(0, 1))
    share = known.agg(F.avg("quality")).first()[0]
    return fit(labelled_texts(documents, known.select("doc_id", F.col("quality").alias("label")), each), share)


def text_scores(model: Mil, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of passages of every text."""
    scores, counts = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
    for a, b in slices(texts, SLICE_CHARS):
        x, first = passages(texts[a:b])
        scores.append(forward(model, x, first)[-1])
        counts.append(np.diff(first))
    return np.concatenate(scores), np.concatenate(counts)


def quality(documents: DataFrame, model: Mil) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= THRESHOLD), n_passages.

    A null or wordless text is one passage without words. Every row is scored from its
    own text; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long"), "text", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            out["score"], out["n_passages"] = text_scores(shared.value, batch["text"].tolist())
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            yield out

    return rows.mapInPandas(score, RESULT)


def with_quality(documents: DataFrame, model: Mil) -> DataFrame:
    """All rows and columns, with ``quality_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    compute = lambda: lambda texts: [text_scores(shared.value, texts)[0]]
    return with_columns(documents, compute, {"quality_score": T.DoubleType()})

"""Language identification by a linear-chain conditional random field over words.

A word's potentials are sums of learned weights of its prefixes, suffixes, byte trigrams
and its entry in a lexicon of training words; labels of neighbouring words are tied by
learned transitions. Training sequences switch languages at random, so transitions learn
what a switch is worth. Forward-backward gives every word its label probabilities, and a
text's language is the label with the largest mean probability.

Texts of any length are exact: words are cut into blocks, block matrices are multiplied
for all blocks at once, chained along each text, and the passes inside the blocks start
from the chained vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.samples import labelled_texts
from locusflow.llm.text import bucket, with_columns
from locusflow.llm.words import Words, range_hash, running_hash, slices, words_of

AFFIXES = (1, 2, 3, 4)
TABLE = 1 << 15
LEXICON_WORDS = 20_000
BLOCK = 32
#: The fitting sample: documents of each language, and the training sequences made from them.
SAMPLE_EACH, SEQUENCES, SEQUENCE_WORDS, SWITCH = 250, 2400, 32, 0.06
UNKNOWN = "und"
SLICE_CHARS = 1_000_000
RESULT = (
    "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint, "
    "runs array<struct<lang:string, first_word:int, n_words:int>>"
)


class Features(NamedTuple):
    """Table rows: one column for each affix, the lexicon row, and trigram rows with their words' ranges."""

    affix: np.ndarray
    lexicon: np.ndarray
    trigram: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Crf(NamedTuple):
    labels: list[str]
    lexicon: np.ndarray  # sorted word hashes
    affix: np.ndarray  # (2 * len(AFFIXES), TABLE, labels)
    word: np.ndarray  # (len(lexicon) + 1, labels), the last row for other words
    trigram: np.ndarray  # (TABLE, labels)
    transition: np.ndarray  # (labels, labels), log potentials


def features(w: Words, lexicon: np.ndarray) -> Features:
    mask = np.uint64(TABLE - 1)
    h = running_hash(w.data) if len(w.data) else np.zeros(1, dtype=np.uint64)
    columns = []
    for k in AFFIXES:
        columns.append(range_hash(h, w.start, np.minimum(w.start + k, w.end)) & mask)
        columns.append(range_hash(h, np.maximum(w.end - k, w.start), w.end) & mask)
    affix = np.stack(columns, axis=1).astype(np.int32)
    at = np.searchsorted(lexicon, w.hash)
    known = (at < len(lexicon)) & (lexicon[np.minimum(at, len(lexicon) - 1)] == w.hash)
    places = np.arange(max(len(w.data) - 2, 0))
    trigram = (range_hash(h, places, places + 3) & mask).astype(np.int32)
    last = np.clip(w.end - 2, w.start, len(trigram))
    return Features(affix, np.where(known, at, len(lexicon)), trigram, np.minimum(w.start, len(trigram)), last)


def emissions(model: Crf, f: Features) -> np.ndarray:
    """(words, labels) log potentials; a word's trigram part is the mean over its trigrams."""
    out = model.word[f.lexicon].astype(np.float64)
    for k in range(f.affix.shape[1]):
        out += model.affix[k][f.affix[:, k]]
    n = np.maximum(f.last - f.first, 1)
    for label in range(out.shape[1]):
        total = np.concatenate([[0.0], np.cumsum(model.trigram[:, label][f.trigram], dtype=np.float64)])
        out[:, label] += (total[f.last] - total[f.first]) / n
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label probabilities of every word. Text i has words first[i] : first[i + 1]; all starts are alike."""
    n, labels = scores.shape
    if n == 0 or labels == 0:
        return scores
    a = np.exp(transition - transition.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    length = np.diff(first)
    per_text = -(-length // block)
    text = np.repeat(np.arange(len(length)), per_text)
    order_in_text = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = first[:-1][text] + order_in_text * block
    size = np.minimum(block, first[1:][text] - begin)
    by_size = np.argsort(-size, kind="stable")
    begin, size, text, order_in_text = begin[by_size], size[by_size], text[by_size], order_in_text[by_size]
    live = [int((size > t).sum()) for t in range(int(size.max()))]

    product = np.zeros((len(begin), labels, labels))
    product[:, np.arange(labels), np.arange(labels)] = e[begin]
    for t, m in enumerate(live[1:], 1):
        step = (product[:m] @ a) * e[begin[:m] + t][:, None, :]
        product[:m] = step / step.sum(axis=(1, 2), keepdims=True)

    slot = np.empty(len(begin), dtype=np.int64)  # blocks in text order
    slot[np.lexsort((order_in_text, text))] = np.arange(len(begin))
    at = np.argsort(slot)
    starts = np.cumsum(per_text) - per_text
    entry, exit_ = np.ones((len(begin), labels)), np.ones((len(begin), labels))
    longest = np.argsort(-per_text, kind="stable")
    counts = [int((per_text > k).sum()) for k in range(int(per_text.max()))]
    for k, m in enumerate(counts[1:], 1):
        now = at[starts[longest[:m]] + k]
        before = at[starts[longest[:m]] + k - 1]
        v = np.einsum("bi,bij->bj", entry[before], product[before]) @ a
        entry[now] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(counts) - 1, 0, -1):
        now = at[starts[longest[: counts[k]]] + k]
        before = at[starts[longest[: counts[k]]] + k - 1]
        v = np.einsum("bij,bj->bi", product[now], exit_[now]) @ a.T
        exit_[before] = v / v.sum(axis=1, keepdims=True)

    out = np.empty((n, labels))
    v = entry
    for t, m in enumerate(live):
        v = (v[:m] @ a if t else v[:m]) * e[begin[:m] + t]
        v = v / v.sum(axis=1, keepdims=True)
        out[begin[:m] + t] = v
    back = exit_.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        own = out[begin[:m] + t] * back[:m]
        out[begin[:m] + t] = own / own.sum(axis=1, keepdims=True)
        v = (e[begin[:m] + t] * back[:m]) @ a.T
        back[:m] = v / v.sum(axis=1, keepdims=True)
    return out


def _training_rows(sample: pd.DataFrame, w: Words, labels: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The words and labels of every training sequence."""
    held = {i: np.flatnonzero((sample["label"] == name).to_numpy() & (np.diff(w.first) > 0)) for i, name in enumerate(labels)}
    held = {i: d for i, d in held.items() if len(d)}
    names = list(held)
    rows = np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64)
    path = np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64)
    for s in range(SEQUENCES):
        label, word, end = None, 0, 0
        for t in range(SEQUENCE_WORDS):
            if label is None or rng.random() < SWITCH:
                label = names[rng.integers(len(names))]
                word = end = 0
            if word >= end:
                text = held[label][rng.integers(len(held[label]))]
                word, end = rng.integers(w.first[text], w.first[text + 1]), w.first[text + 1]
            rows[s, t], path[s, t] = word, label
            word += 1
    return rows, path


def fit(sample: pd.DataFrame, epochs: int = 4, batch: int = 200, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by adaptive gradient steps; one language alone needs no fitting."""
    labels = sorted(sample["label"].unique())
    n, rng = len(labels), np.random.default_rng(7)
    if not n:
        return Crf([], np.zeros(1, np.uint64), np.zeros((2 * len(AFFIXES), TABLE, 0)), np.zeros((2, 0)), np.zeros((TABLE, 0)), np.zeros((0, 0)))
    w = words_of(sample["text"].tolist())
    seen, count = np.unique(w.hash, return_counts=True)
    lexicon = np.sort(seen[np.argsort(-count, kind="stable")[:LEXICON_WORDS]])
    if not len(lexicon):
        lexicon = np.zeros(1, dtype=np.uint64)
    model = Crf(
        labels, lexicon, np.zeros((2 * len(AFFIXES), TABLE, n)), np.zeros((len(lexicon) + 1, n)),
        np.zeros((TABLE, n)), np.zeros((n, n)),
    )
    if n == 1 or not len(w.hash):
        return model
    rows, path = _training_rows(sample, w, labels, rng)
    f = features(w, lexicon)
    tables = [*model.affix, model.word, model.trigram, model.transition]
    gathered = [np.full_like(t, 1e-3) for t in tables]
    first = np.arange(batch + 1) * SEQUENCE_WORDS
    for _ in range(epochs):
        order = rng.permutation(SEQUENCES)
        for start in range(0, SEQUENCES - batch + 1, batch):
            at = rows[order[start : start + batch]].ravel()
            gold = path[order[start : start + batch]].ravel()
            own = Features(f.affix[at], f.lexicon[at], f.trigram, f.first[at], f.last[at])
            e = emissions(model, own)
            p = marginals(e, first, model.transition)
            delta = -p
            delta[np.arange(len(gold)), gold] += 1
            grads = [_spread(own.affix[:, k], delta, TABLE) for k in range(own.affix.shape[1])]
            grads.append(_spread(own.lexicon, delta, len(lexicon) + 1))
            size = np.maximum(own.last - own.first, 0)
            place = np.repeat(own.first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            grads.append(_spread(f.trigram[place], np.repeat(delta / np.maximum(size, 1)[:, None], size, axis=0), TABLE))
            grads.append(_transition_gradient(e, model.transition, gold.reshape(batch, -1)))
            for table, g, total in zip(tables, grads, gathered):
                g -= decay * table
                total += g * g
                table += rate * g / np.sqrt(total)
    return model._replace(**{c: getattr(model, c).astype(np.float32) for c in ("affix", "word", "trigram")})


def _spread(at: np.ndarray, delta: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=delta[:, k], minlength=size) for k in range(delta.shape[1])], axis=1)


def _transition_gradient(e: np.ndarray, transition: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Seen minus expected label pairs of sequences of one length."""
    batch, steps = gold.shape
    x = np.exp(e - e.max(axis=1, keepdims=True)).reshape(batch, steps, -1)
    a = np.exp(transition)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = x[:, 0]
    for t in range(1, steps):
        alpha[:, t] = (alpha[:, t - 1] @ a) * x[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = (x[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros_like(transition)
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return seen - pair.sum(axis=(0, 1))


def label_words(model: Crf, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the (words, labels) probabilities and the mean over its words."""
    for a, b in slices(texts, SLICE_CHARS):
        w = words_of(texts[a:b])
        p = marginals(emissions(model, features(w, model.lexicon)), w.first, model.transition)
        for i in range(b - a):
            own = p[w.first[i] : w.first[i + 1]]
            yield own, own.mean(axis=0) if len(own) else np.zeros(len(model.labels))


def _runs(model: Crf, own: np.ndarray) -> list[dict]:
    best = own.argmax(axis=1)
    cut = np.flatnonzero(np.diff(best, prepend=-1))
    return [
        {"lang": model.labels[best[i]], "first_word": int(i), "n_words": int(n)}
        for i, n in zip(cut, np.diff(cut, append=len(best)))
    ]


def training_model(documents: DataFrame, each: int = SAMPLE_EACH) -> Crf:
    """Fitted on rows whose bucket is not 0 and whose ``lang`` is known."""
    learned = documents.where((bucket(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    return fit(labelled_texts(learned, learned.select("doc_id", F.col("lang").alias("label")), each))


def identify(documents: DataFrame, model: Crf, runs: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words, runs.

    ``runs`` lists stretches of words of one language, in order. A null text, a text
    without a letter, or a model without labels gives ``und`` with score 0. Equal means go
    to the label that sorts first. Every row is labelled on its own; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(
        F.col("doc_id").cast("long"), "text", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            out = []
            for letters, (own, mean) in zip(batch["letters"], label_words(crf, batch["text"].tolist())):
                if letters and len(own) and len(mean):
                    best = int(mean.argmax())
                    out.append((crf.labels[best], min(float(mean[best]), 1.0), len(own), _runs(crf, own) if runs else []))
                else:
                    out.append((UNKNOWN, 0.0, len(own), []))
            found = pd.DataFrame(out, columns=["lang_pred", "score", "n_words", "runs"])
            found.insert(0, "held_out", batch["held_out"].to_numpy())
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    return rows.mapInPandas(label, RESULT)


def with_language(documents: DataFrame, model: Crf) -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``lang_score`` as ``identify`` gives them.

    ``lang_certainty`` is the mean of each word's largest label probability: how surely the
    words are labelled, whether or not they share a language. It is 0 where ``lang_score`` is.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compute():
        crf = shared.value

        def label(texts: list[str | None]):
            names, scores, certainties = [], [], []
            for t, (own, mean) in zip(texts, label_words(crf, texts)):
                real = bool(len(mean)) and mean.any() and any(c.isalpha() for c in t or "")
                names.append(crf.labels[int(mean.argmax())] if real else UNKNOWN)
                scores.append(min(float(mean.max()), 1.0) if real else 0.0)
                certainties.append(min(float(own.max(axis=1).mean()), 1.0) if real else 0.0)
            return names, scores, certainties

        return label

    return with_columns(
        documents, compute, {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_certainty": T.DoubleType()}
    )

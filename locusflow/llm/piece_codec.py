"""SentencePiece encoding and decoding: batched Viterbi over equal-length words.

A text gets a leading space, spaces become the visible mark, and words start at a run of
marks. No piece crosses a word, so words are segmented on their own and only once per task
while they stay in a bounded cache. Words of one length form a matrix: running hashes give
every substring's key, a binary search in the sorted piece keys gives its piece, and at
each position one vectorised maximum over the possible last pieces sets score and back
pointer. Characters outside the vocabulary, and a mark that is part of the text, become byte
pieces, so decoding gives the text back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.text import with_columns
from locusflow.llm.words import mix, slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that is part of the text while words are cut; no text holds this code point.
_ESCAPED = "\ud800"
#: Characters that end a word when no piece of two or more characters holds them.
_BREAKS = "\n\t"
#: A byte piece costs so much more than the worst piece.
BYTE_PENALTY = 10.0
CACHED_WORDS = 600_000
#: Characters encoded at once, unless one text alone is longer.
PART_CHARS = 2_000_000
_HINT_BITS = np.uint64((1 << 20) - 1)
_P = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class Pieces(NamedTuple):
    """A vocabulary: sorted keys of its text pieces with ids and scores, and what each id decodes to."""

    keys: np.ndarray
    hint: np.ndarray  # for the low bits of a key: whether any piece has them
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_score: float
    decoded: list[bytes]
    word: str  # pattern of a word


def _hash_ranges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of the rows of ``codes`` and the powers that shift a difference to position 0."""
    n = codes.shape[1]
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P, dtype=np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, dtype=np.uint64)]))
    h = np.zeros((len(codes), n + 1), dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1, out=h[:, 1:])
    return h, down


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32).reshape(len(words), -1)


def build(texts: list[tuple[str, int, float]], byte_ids: dict[int, int], size: int) -> Pieces:
    """Pieces from (text, id, score) rows and the ids of the 256 byte pieces; equal texts keep the better score."""
    best: dict[str, tuple[float, int]] = {}
    for text, i, score in texts:
        if text and (text not in best or score > best[text][0]):
            best[text] = (score, i)
    keys, ids, scores = [], [], []
    by_length: dict[int, list[str]] = {}
    for text in best:
        by_length.setdefault(len(text), []).append(text)
    for n, held in by_length.items():
        h, _ = _hash_ranges(_codes(held))
        keys.append(mix(h[:, n] + np.uint64(n)))
        ids += [best[t][1] for t in held]
        scores += [best[t][0] for t in held]
    keys, ids, scores = np.concatenate(keys), np.array(ids, dtype=np.int32), np.array(scores)
    order = np.argsort(keys)
    decoded = [b""] * size
    for text, i, _ in texts:
        decoded[i] = text.replace(MARK, " ").encode("utf-8")
    for value, i in byte_ids.items():
        decoded[i] = bytes([value])
    hint = np.zeros(int(_HINT_BITS) + 1, dtype=bool)
    hint[keys & _HINT_BITS] = True
    breaks = "".join(c for c in _BREAKS if not any(c in t for t in best if len(t) > 1))
    word = f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]" if breaks else "")
    return Pieces(
        keys[order], hint, ids[order], scores[order], max(by_length),
        np.array([byte_ids[b] for b in range(256)], dtype=np.int32), float(scores.min()) - BYTE_PENALTY, decoded, word,
    )


def load(model_file: str = MODEL_FILE, shift: float = 20.0) -> Pieces:
    """The vocabulary of a model file. Pieces of a merge-ranked model score -log(rank + shift), others as stored."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
    stored = np.array([p.get_score(i) for i in plain])
    if (stored == np.round(stored)).all():
        rank = np.empty(len(plain))
        rank[np.argsort(-stored, kind="stable")] = np.arange(len(plain))
        stored = -np.log(rank + shift)
    bytes_of = {int(p.id_to_piece(i)[3:5], 16): i for i in range(p.get_piece_size()) if p.is_byte(i)}
    return build([(p.id_to_piece(i), i, s) for i, s in zip(plain, stored.tolist())], bytes_of, p.get_piece_size())


def viterbi(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words in a row, and how many each has; all words have the same length."""
    codes = _codes(words)
    n, length = codes.shape
    h, down = _hash_ranges(codes)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), dtype=np.int16)
    chosen = np.full((n, length + 1), -1, dtype=np.int32)
    width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    for end in range(1, length + 1):
        first = max(0, end - pieces.longest)
        starts = np.arange(first, end)
        keys = mix((h[:, end, None] - h[:, first:end]) * down[starts] + (end - starts).astype(np.uint64))
        row, column = np.nonzero(pieces.hint[keys & _HINT_BITS])
        probe = keys[row, column]
        at = np.minimum(np.searchsorted(pieces.keys, probe), len(pieces.keys) - 1)
        found = pieces.keys[at] == probe
        row, column, at = row[found], column[found], at[found]
        piece = np.zeros(keys.shape, dtype=np.int32)
        score = np.full(keys.shape, -np.inf)
        piece[row, column] = pieces.ids[at]
        score[row, column] = pieces.scores[at]
        score += best[:, first:end]
        last = score.argmax(axis=1)
        rows = np.arange(n)
        top = score[rows, last]
        as_bytes = best[:, end - 1] + pieces.byte_score * width[:, end - 1]
        by_piece = top >= as_bytes
        best[:, end] = np.where(by_piece, top, as_bytes)
        back[:, end] = np.where(by_piece, end - first - last, 1)
        chosen[:, end] = np.where(by_piece, piece[rows, last], -1)
    return _traced(pieces, words, back, chosen)


def _traced(pieces: Pieces, words: list[str], back: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids in a row, and how many each word has; back pointers are followed for all words at once."""
    n, length = len(words), back.shape[1] - 1
    ids = np.zeros((n, length), dtype=np.int32)
    at, count = np.full(n, length), np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    while len(rows):
        ids[rows, length - 1 - count[rows]] = chosen[rows, at[rows]]
        count[rows] += 1
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    used = np.arange(length) >= length - count[:, None]
    odd = np.flatnonzero(((ids < 0) & used).any(axis=1))
    if not len(odd):
        return ids[used], count
    written = {int(r): _with_bytes(pieces, words[r], ids[r, used[r]], back[r]) for r in odd}
    total = count.copy()
    total[odd] = [len(written[int(r)]) for r in odd]
    ends = np.cumsum(total)
    plain = np.ones(n, dtype=bool)
    plain[odd] = False
    flat = np.zeros(ends[-1], dtype=np.int32)
    flat[np.repeat(plain, total)] = ids[used & plain[:, None]]
    for r, own in written.items():
        flat[ends[r] - len(own) : ends[r]] = own
    return flat, total


def _with_bytes(pieces: Pieces, word: str, ids: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Ids of a word whose characters without a piece (-1) are written in byte pieces."""
    steps, end = [], len(word)
    while end:
        steps.append(end)
        end -= int(back[end])
    out = []
    for i, end in zip(ids, reversed(steps)):
        if i >= 0:
            out.append(i)
        else:
            raw = MARK.encode() if word[end - 1] == _ESCAPED else word[end - 1].encode("utf-8", "surrogatepass")
            out.extend(pieces.byte_ids[b] for b in raw)
    return np.array(out, dtype=np.int32)


class Encoder:
    """Encodes texts of one task, remembering a bounded number of words."""

    def __init__(self, pieces: Pieces, cached: int = CACHED_WORDS):
        self.pieces, self.cached, self.word = pieces, cached, re.compile(pieces.word)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        ids, count, known = [self.ids], [self.count], len(self.place)
        for length, held in by_length.items():
            step = max(1, 200_000 // length)
            for a in range(0, len(held), step):
                part = held[a : a + step]
                new_ids, new_count = viterbi(self.pieces, part)
                ids.append(new_ids)
                count.append(new_count)
                self.place.update(zip(part, range(known, known + len(part))))
                known += len(part)
        self.ids, self.count = np.concatenate(ids), np.concatenate(count)
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.word.findall(MARK + t.replace(MARK, _ESCAPED).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.place) > self.cached:
            self.forget()
        new = set(chain.from_iterable(cut)).difference(self.place)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        count = self.count[at]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(self.start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode(pieces: Pieces, ids) -> str:
    """The text of a sequence of ids; the leading space goes."""
    return b"".join(map(pieces.decoded.__getitem__, np.asarray(ids).tolist()))[1:].decode("utf-8", "surrogatepass")


def encode_texts(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns and rows, with ``token_ids`` (a column of that name is replaced).

    A null text has null ids, an empty one none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)

    def compute():
        encoder = Encoder(shared.value)

        def encode(texts: list[str | None]):
            out = []
            for a, b in slices(texts, PART_CHARS):
                ids = encoder.encode([t or "" for t in texts[a:b]])
                out += [None if t is None else i for t, i in zip(texts[a:b], ids)]
            return [out]

        return encode

    return with_columns(documents, compute, {"token_ids": T.ArrayType(T.IntegerType())})


def decode_texts(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns and rows, with ``decoded``, the text of ``token_ids``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def decode_all(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else decode(shared.value, i) for i in ids], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(decode_all, T.StringType())("token_ids"))


def token_report(documents: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """One row per document: doc_id, token_ids, n_tokens, round_trip (decoding the ids gives the text back)."""
    shared = documents.sparkSession.sparkContext.broadcast(load(model_file))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, encoder = shared.value, Encoder(shared.value)
        for batch in batches:
            texts, doc_ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for a, b in slices(texts, PART_CHARS):
                part = texts[a:b]
                ids = encoder.encode([t or "" for t in part])
                same = [t is None or decode(pieces, i) == t for t, i in zip(part, ids)]
                held = [None if t is None else i for t, i in zip(part, ids)]
                yield pd.DataFrame({
                    "doc_id": doc_ids[a:b], "token_ids": pd.Series(held, dtype=object),
                    "n_tokens": [len(i) for i in ids], "round_trip": same,
                })

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(report, "doc_id bigint, token_ids array<int>, n_tokens bigint, round_trip boolean")

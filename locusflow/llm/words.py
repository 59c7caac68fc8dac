"""Words of many texts at once: numpy over their UTF-8 bytes.

Texts are joined into one buffer. Words are the runs of bytes outside a set of ASCII
separators, so no character is ever cut. A word's 64-bit hash comes from one running sum of
byte * p**position: the difference between its ends, divided by p**start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Most characters of text handled at once, unless one text alone is longer.
BUFFER_BYTES = 900_000
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a few texts: byte ranges in ``data``, hashes, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has words first[i] : first[i + 1]
    text_start: np.ndarray  # text i has bytes text_start[i] : text_start[i + 1] - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _P, dtype=np.uint64)
        down = np.full(n, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def running_hash(data: np.ndarray) -> np.ndarray:
    """h with h[b] - h[a] = sum of (byte + 1) * p**position over data[a:b]."""
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def words_of(texts: list[str | None], separators: np.ndarray = WHITESPACE, lower: bool = True) -> Words:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", dtype=np.uint8)
    text_start = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=text_start[1:])
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = running_hash(data) if len(data) else np.zeros(1, dtype=np.uint64)
    return Words(data, start, end, range_hash(h, start, end), np.searchsorted(start, text_start), text_start)


def slices(texts: list[str | None], most: int = BUFFER_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``most`` characters, or of one longer text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)

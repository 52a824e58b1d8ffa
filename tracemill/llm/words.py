"""Words and their hashes for whole Arrow batches, as NumPy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 that is a maximal run of code points other
than those six. Hashes have 64 bits; two different keys that are compared share one with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of the kernels takes, so that its arrays stay in the tens of MB; a longer text is a step of its own.
STEP_BYTES = 2_000_000
#: Texts of a step at most, so that a text's place in it has two bytes.
STEP_TEXTS = 60_000

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LETTER = np.ones(256, bool)
_LETTER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C55)


class Words(NamedTuple):
    """starts, ends: byte places in data; first: for each text the number of its first word, and one more at the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, each with its texts' bytes and offsets. A null text is empty."""
    for batch in batches:
        array = batch.column(column).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(array):
            to = int(np.searchsorted(offsets, offsets[at] + step_bytes, "right")) - 1
            to = min(max(to, at + 1), at + STEP_TEXTS, len(array))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False) -> Words:
    """The words of the texts that stand one after the other in data; with letters, a word is a run of ASCII letters and digits and all bytes beyond ASCII."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        return Words(data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = (_LETTER if letters else _WORD)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets).astype(np.int64))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, made of some MB of text at once."""
    n = len(words.starts)
    out = np.empty(n, np.uint64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(words.starts, words.starts[at] + STEP_BYTES)))
        out[at:to] = _hashes(words.data, words.starts[at:to], words.ends[at:to], int(words.starts[to]) if to < n else len(words.data))
        at = to
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    base = int(starts[0])
    # place of each byte in its word; separators get factor 0
    place = np.arange(base, end)
    gaps = np.diff(starts, append=end)
    place -= np.repeat(starts, gaps)
    table = powers(int(gaps.max()))
    value = data[base:end].astype(np.uint64)
    value += np.uint64(1)
    value *= table[place]
    value[place >= np.repeat(ends - starts, gaps)] = 0  # what stands between words
    out = np.add.reduceat(value, starts - base)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k words from each word on, and whether they are all in its text. Both as long as h; the former is arbitrary where the latter is false."""
    out = np.zeros(len(h), np.uint64)
    whole = np.zeros(len(h), bool)
    if len(h) >= k:
        m = len(h) - k + 1
        factor = powers(k + 1)[1:]
        for j in range(k):
            out[:m] += h[j : j + m] * factor[j]
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
        whole = left >= k
    return mix(out), whole


def ranges(h: np.ndarray, n: int) -> np.ndarray:
    """For hashes in rising order the n + 1 places that cut them into n equal ranges of the hash space."""
    cuts = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]]).astype(np.int64)

"""Operator 7: benchmark decontamination by SimHash of item-sized windows.

A window of a text has as many words as an item; a text with fewer is one window. Windows and items get a SimHash of BITS
bits of their five-word shingles, each as often as it stands there. A multi-index takes items within RADIUS of a window's
fingerprint: of the blocks of 16 bits one at least differs in RADIUS // BLOCKS bits or fewer. Each item stands under all
values of each block that differ in some of these bits, a lookup tries all that differ in the others; so none within the
radius is missed, and a lookup meets a small share of the other items. Candidates are verified by exact weighted Jaccard
similarity of the two multisets.

A window gets a fingerprint only if as many of its shingles as that similarity needs stand in items of its size, whichever
these are; windows with fewer cannot be similar to any. The items are a query set: they go to every task in blocks of a
bounded size, and all texts meet each block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents

K = 5
#: Of BITS bits, two multisets of similarity 0.8 differ in about 19, by 4 more or less: the radius is 3 such deviations beyond.
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Bits of a block by which an item's own values differ; lookups take the rest of RADIUS // BLOCKS.
STORED = 1
#: Items go to the tasks in blocks of about so many bytes of text.
BLOCK_BYTES = 4_000_000
_BITMAP = 22
#: Windows that get fingerprints at once.
_AT_ONCE = 256


def _masks(radius: int, bits: int = BITS // BLOCKS) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(bits), n)], np.uint16)


def fingerprints(s: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The SimHash, as BLOCKS numbers of 16 bits, of the `length` shingles from each start on."""
    out = np.empty((len(starts), BLOCKS), np.uint16)
    for a in range(0, len(starts), _AT_ONCE):
        own = s[starts[a : a + _AT_ONCE, None] + np.arange(length)]
        raw = np.stack([own, W.mix(own + np.uint64(1))], axis=2).view(np.uint8)
        ones = np.unpackbits(raw.reshape(*own.shape, BITS // 8), axis=2).sum(axis=1, dtype=np.int32)
        out[a : a + _AT_ONCE] = np.packbits(2 * ones > length, axis=1).view(np.uint16)
    return out


class Items:
    """The items of a block: their shingles by size, and the multi-index of their fingerprints."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.bags, prints, sizes = [], [], [], []
        held: dict[int, set[tuple[int, int]]] = {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
            words = W.split(raw, np.array([0, len(raw)]), lower=True, letters=True)
            size = len(words.starts)
            if not size:
                continue
            s, whole = W.shingles(W.hashes(words), words.first, min(K, size))
            s = s[whole]
            self.ids.append(item_id)
            sizes.append(size)
            self.bags.append(Counter(s.tolist()))
            prints.append(fingerprints(s, np.array([0]), len(s))[0])
            held.setdefault(min(K, size), set()).update((x, size) for x in self.bags[-1])
        self.prints, self.sizes = np.array(prints, np.uint16).reshape(-1, BLOCKS), np.array(sizes, np.int64)
        #: by the number of words in a shingle: the bitmap of shingles, and (shingle, size) in rising order
        self.bitmaps: dict[int, np.ndarray] = {}
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, own in held.items():
            keys, size = np.array([x for x, _ in own], np.uint64), np.array([x for _, x in own], np.int64)
            by = np.lexsort((size, keys))
            self.shingles[k] = keys[by], size[by]
            self.bitmaps[k] = np.zeros(1 << _BITMAP, bool)
            self.bitmaps[k][keys >> np.uint64(64 - _BITMAP)] = True
        #: by size: block and value in rising order, and the item that stands there
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        near, block = _masks(STORED), np.arange(BLOCKS, dtype=np.int32) << 16
        for size in set(sizes):
            own = np.flatnonzero(self.sizes == size).astype(np.int32)
            keys = (block[None, :, None] | (self.prints[own][:, :, None] ^ near)).reshape(len(own), -1)
            at = np.argsort(keys, axis=None, kind="stable")
            self.index[size] = keys.ravel()[at], np.repeat(own, keys.shape[1])[at]
        self._lookups = _masks(RADIUS // BLOCKS - STORED)

    def near(self, size: int, print_: np.ndarray) -> list[int]:
        """The items of this size whose fingerprint is within the radius."""
        keys, items = self.index[size]
        tried = ((np.arange(BLOCKS, dtype=np.int32) << 16)[:, None] | (print_[:, None] ^ self._lookups)).ravel()
        low, high = np.searchsorted(keys, tried), np.searchsorted(keys, tried, "right")
        found = {i for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True) for i in items[a:b].tolist()}
        return [i for i in sorted(found) if int(np.bitwise_count(self.prints[i] ^ print_).sum()) <= RADIUS]

    def hits(self, h: np.ndarray, first: np.ndarray, percent: int) -> list[tuple]:
        """For texts, by their words' hashes and where each begins: (text, item, start, words, similarity, windows)."""
        best: dict[tuple[int, int], list] = {}

        def test(text: int, size: int, start: int, print_: np.ndarray, own: np.ndarray) -> None:
            for i in self.near(size, print_):
                window = Counter(own.tolist())
                common = (window & self.bags[i]).total()
                union = len(own) + self.bags[i].total() - common
                if 100 * common >= percent * union:
                    got = best.setdefault((text, i), [0.0, start, 0])
                    got[2] += 1
                    if common / union > got[0]:
                        got[:2] = common / union, start

        for k, (keys, sizes) in self.shingles.items():
            s, whole = W.shingles(h, first, k)
            at = np.flatnonzero(self.bitmaps[k][s >> np.uint64(64 - _BITMAP)] & whole)
            low, high = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], "right")
            n = high - low
            place = np.repeat(at, n)
            size = sizes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(place))]
            by = np.argsort(size, kind="stable")
            place, size = place[by], size[by]
            for z, a, b in zip(*(x.tolist() for x in _runs(size)), strict=True):
                p, m = place[a:b], z - k + 1
                text = np.searchsorted(first, p, "right") - 1
                begin, end = first[text], first[text + 1]
                # the whole text, where it has fewer words than the items
                for _, c, d in zip(*(x.tolist() for x in _runs(np.where(end - begin < z, text, -1))), strict=True):
                    own = int(end[c] - begin[c]) - k + 1
                    if end[c] - begin[c] < z and d - c >= _needed(own, m, percent):
                        there = s[begin[c] : begin[c] + own]
                        test(int(text[c]), z, 0, fingerprints(there, np.array([0]), own)[0], there)
                # windows with enough shingles of items of this size
                need = _needed(m, m, percent)
                one, last = p[: len(p) - need + 1], p[need - 1 :]
                close = np.flatnonzero((last - one < m) & (text[: len(one)] == text[need - 1 :]) & (end - begin >= z)[: len(one)])
                if not len(close):
                    continue
                from_, to = np.maximum(last[close] - m + 1, begin[close]), np.minimum(one[close], end[close] - z) + 1
                n = np.maximum(to - from_, 0)
                starts = np.unique(np.repeat(from_ - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                holder = np.searchsorted(first, starts, "right") - 1
                for t, start, print_ in zip(holder.tolist(), starts.tolist(), fingerprints(s, starts, m), strict=True):
                    test(t, z, start - int(first[t]), print_, s[start : start + m])
        return [(t, self.ids[i], start, int(min(first[t + 1] - first[t], self.sizes[i])), similarity, windows) for (t, i), (similarity, start, windows) in sorted(best.items())]


def _needed(one: int, two: int, percent: int) -> int:
    """How many shingles two multisets of these sizes must have in common."""
    return max(1, -(-percent * (one + two) // (100 + percent)))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of equal values: value, begin, end."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[begin], begin, np.append(begin[1:], len(x))[: len(begin)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """A row for each row of docs and item of which a window is similar: sig, doc_id, item_id, first_word, n_words, similarity, n_windows.

    docs needs doc_id and text, benchmark item_id and text; whatever else they have is ignored. A-Z is lower-cased; words
    are runs of letters, digits and all beyond ASCII; an item of fewer than five words is one shingle of all. similarity
    is weighted Jaccard, as a fraction, of the best window, the first of several; n_windows counts those with percent / 100
    or more. Null, empty or wordless texts and items match nothing, nor do texts of fewer words than a shingle; a
    text with fewer words than the item is its only window. A null doc_id or
    item_id stays null. Repeated rows and items give repeated rows; an empty table gives an empty result. sig is a hash of
    doc_id and text. Similar pairs are missed only where their fingerprints differ in more than RADIUS bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["doc_id"].isNull(), docs["text"].isNull()).alias("sig"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("size")).first().size or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in own]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own: Items = index.value
            for batch, data, offsets in W.steps(batches):
                words = W.split(data, offsets, lower=True, letters=True)
                sig, doc_id = batch.column("sig"), batch.column("doc_id")
                found = [(sig[t].as_py(), doc_id[t].as_py(), *hit) for t, *hit in own.hits(W.hashes(words), words.first, percent)]
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["sig", "doc_id", "item_id", "first_word", "n_words", "similarity", "n_windows"])

        part = rows.mapInArrow(run, "sig long, doc_id long, item_id long, first_word long, n_words long, similarity double, n_windows long")
        out = part if out is None else out.union(part)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("sig")

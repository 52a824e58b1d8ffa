"""Operator 10: substring dedup by seed and extend.

Seeds are winnowed anchors: of the 5-word grams of every window of 13 words, the one with the smallest hash. Equal
windows have equal anchors, so documents that share a window of 13 words meet at an anchor. Anchors of one text only
seed nothing. Around every shared anchor the match is extended to all windows of 13 words that the anchor stands for;
equal windows are joined, and each is charged to the smallest doc_id that has it. Runs of matched windows, one after the
other, are the maximal repeats: every word that one covers in a document with a larger doc_id goes.

Windows are compared by 96 bits: a hash of 64, and 32 more of another one.

Which anchors are shared is told to the second pass by a bitmap of a fixed size, cut by hash range, that has two bits for
each shared anchor. It only saves work: a bit set by chance sends windows on that then match nothing, and none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, fragments

GRAM = 5
#: Bits of the bitmap of shared anchors; its 8 MB are all that the driver and the workers hold, whatever the input.
BITMAP_BITS = 1 << 26
_LAST = np.iinfo(np.int64).max
_CHECK = np.uint64(0xD1B54A32D192ED03)
_SEED = "part int, hashes binary, many binary"
_MATCH = "part int, chunk long, hashes binary, checks binary, places binary, starts binary, ids binary, sigs binary"
_COVER = "chunk long, places binary, starts binary, sigs binary"


def _anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the anchor of the window that starts there, and whether that window is in its text."""
    gram, _ = W.shingles(h, first, GRAM)
    _, whole = W.shingles(h, first, window)
    least, span, width = gram.copy(), 1, window - GRAM + 1
    while span < width:
        step = min(span, width - span)
        if step < len(least):  # no window is longer than all words
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least, whole


def _bits(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each anchor in its range's segment of the bitmap."""
    n = np.uint64(BITMAP_BITS // parts // 8 * 8 or 8)
    x = W.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return (x % n).astype(np.int64), ((x >> np.uint64(32)) % n).astype(np.int64)


def _seeds(parts: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in W.steps(batches):
            words = W.split(data, offsets)
            anchor, whole = _anchors(W.hashes(words), words.first, window)
            text = words.texts()
            new = whole.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            anchor, text = anchor[new], text[new]
            by = np.argsort(anchor, kind="stable")
            anchor, text = anchor[by], text[by]
            at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else [])
            many = np.maximum.reduceat(text, at) != np.minimum.reduceat(text, at) if len(at) else np.empty(0, bool)
            keys = anchor[at]
            cut = W.ranges(keys, parts)
            rows = [(p, keys[a:b].tobytes(), many[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "hashes", "many"])

    return run


def _shared(parts: int):
    """All anchors of one hash range -> that range's segment of the bitmap."""

    def run(rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()])
        many = np.concatenate([np.frombuffer(x, bool) for x in rows["many"].to_pylist()])
        by = np.argsort(h, kind="stable")
        h, many = h[by], many[by]
        same = h[1:] == h[:-1]
        many[1:] |= same
        many[:-1] |= same
        bits = np.zeros(BITMAP_BITS // parts // 8 * 8 or 8, bool)
        for at in _bits(h[many], parts):
            bits[at] = True
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


def _windows(parts: int, window: int, bitmap):
    """documents -> the windows under shared anchors, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, chunk = bitmap.value, TaskContext.get().partitionId() << 24
        for batch, data, offsets in W.steps(batches):
            chunk += 1
            words = W.split(data, offsets)
            h = W.hashes(words)
            anchor, whole = _anchors(h, words.first, window)
            start = np.flatnonzero(whole)
            seed = anchor[start]
            # the segment of an anchor: its range, as W.ranges cuts them
            cuts = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
            new = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]) if len(seed) else [])
            keys = seed[new]
            part = np.searchsorted(cuts, keys, "right")
            hit = np.ones(len(keys), bool)
            for at in _bits(keys, parts):
                hit &= (segments[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            start = start[np.repeat(hit, np.diff(new, append=len(seed)))]
            if not len(start):
                continue
            key = W.shingles(h, words.first, window)[0][start]
            check = (W.shingles(W.mix(h ^ _CHECK), words.first, window)[0][start] >> np.uint64(32)).astype(np.uint32)
            text = words.texts()[start]
            by = np.argsort(key, kind="stable")
            key, check, start, text = key[by], check[by], start[by], text[by]
            ids = np.asarray(batch.column("doc_id").fill_null(_LAST))
            sigs = np.asarray(batch.column("sig"))
            cut = W.ranges(key, parts)
            rows = []
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    used, place = np.unique(text[a:b], return_inverse=True)
                    rows.append((p, chunk, key[a:b].tobytes(), check[a:b].tobytes(), place.astype(np.uint16).tobytes(), (start[a:b] - words.first[text[a:b]]).astype(np.uint32).tobytes(), ids[used].tobytes(), sigs[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int64()] + [pa.binary()] * 6)], names=["part", "chunk", "hashes", "checks", "places", "starts", "ids", "sigs"])

    return run


def _covers(rows: pa.Table) -> pa.Table:
    """All windows of one hash range -> by step, those that also start in a document with a smaller doc_id."""
    runs = list(zip(*([np.frombuffer(x, t) for x in rows[c].to_pylist()] for c, t in (("hashes", np.uint64), ("places", np.uint16), ("starts", np.uint32), ("ids", np.int64), ("sigs", np.int64), ("checks", np.uint32))), strict=True))
    h, check = (np.concatenate([r[i] for r in runs]) for i in (0, 5))
    doc = np.concatenate([r[3][r[1]] for r in runs])
    by = np.argsort(h, kind="stable")
    if ((h[by][1:] == h[by][:-1]) & (check[by][1:] != check[by][:-1])).any():  # different windows with the same 64 bits
        by = np.lexsort((check, h))
    h, check, own = h[by], check[by], doc[by]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
    least = np.minimum.reduceat(own, at)
    gone = np.empty(len(h), bool)
    gone[by] = own > np.repeat(least, np.diff(at, append=len(h)))
    del h, check, own, by, doc
    out, done = [], 0
    for chunk, (key, place, start, _, sig, _) in zip(rows["chunk"].to_pylist(), runs, strict=True):
        mask = gone[done : done + len(key)]
        done += len(key)
        if mask.any():
            used, place = np.unique(place[mask], return_inverse=True)
            out.append((chunk, place.astype(np.uint16).tobytes(), start[mask].tobytes(), sig[used].tobytes()))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] + [pa.binary()] * 3)], names=["chunk", "places", "starts", "sigs"])


def _gathered(rows: pa.Table) -> pa.Table:
    """All covers of one step of a task -> for each text the starts of its matched windows, in order."""
    got = [(np.frombuffer(g, np.int64)[np.frombuffer(p, np.uint16)], np.frombuffer(s, np.uint32)) for p, s, g in zip(*(rows[c].to_pylist() for c in ("places", "starts", "sigs")), strict=True)]
    sig, start = (np.concatenate(x) for x in zip(*got, strict=True))
    by = np.lexsort((start, sig))
    sig, start = sig[by], start[by]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    return pa.table({"sig": pa.array(sig[first]), "starts": pa.array([start[a:b].tobytes() for a, b in zip(first, [*first[1:], len(sig)], strict=True)], pa.binary())})


def _removed(window: int):
    """Texts with the starts of their matched windows -> the counts and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.steps(batches):
            words = W.split(data, offsets)
            n = len(words.starts)
            change = np.zeros(n + 1, np.int64)
            for t, run in enumerate(batch.column("starts").to_pylist()):
                if run:
                    start = np.unique(np.frombuffer(run, np.uint32)).astype(np.int64) + words.first[t]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + window, -1)
            kept = np.cumsum(change[:n]) == 0
            count = np.concatenate([[0], np.cumsum(~kept)])
            edge = np.zeros(len(data) + 1, np.int8)
            edge[words.starts[kept]] += 1
            edge[words.ends[kept]] -= 1
            mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            # the byte after a word is its separator, unless the text ends there
            after = words.ends[kept & (words.ends < np.repeat(offsets[1:], np.diff(words.first)))]
            out = data.copy()
            out[after] = 0x20
            mask[after] = True
            total = np.concatenate([[0], np.cumsum(mask)])
            place, flat = total[offsets], out[mask]
            digests = []
            for a, b in zip(place[:-1], place[1:], strict=True):
                text = flat[a:b].tobytes()
                digests.append(hashlib.sha256(text[:-1] if text.endswith(b" ") else text).hexdigest())
            first = words.first
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(count[first[1:]] - count[first[:-1]]), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    docs needs doc_id and text; whatever else it has is ignored. Words are maximal runs other than [\\x20\\x09-\\x0D],
    unchanged; a null, empty or blank text has none, and keeps the empty string. A window is `window` consecutive words of
    a text. Every word goes that a window covers whose words also start in a row with a smaller doc_id. A null doc_id
    counts as larger than any other; rows with the same doc_id take nothing from each other, nor do repeats within a text.
    kept_sha256 is the lower-case hexadecimal SHA-256 of the kept words joined by one space, in UTF-8. A text with fewer
    words than the window is kept whole. An empty table gives an empty result. window must be over GRAM + 1.
    """
    spark = docs.sparkSession
    parts = fragments(docs)
    signed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = signed.withColumn("sig", F.xxhash64("doc_id", "text", F.isnull("doc_id")))
    width = (BITMAP_BITS // parts // 8 * 8 or 8) // 8
    seeds = signed.select("text").mapInArrow(_seeds(parts, window), _SEED)
    segments = np.zeros((parts, width), np.uint8)
    for part, bits in seeds.groupBy("part").applyInArrow(_shared(parts), "part int, bits binary").collect():
        segments[part] = np.frombuffer(bits, np.uint8)
    windows = signed.mapInArrow(_windows(parts, window, spark.sparkContext.broadcast(segments)), _MATCH)
    covers = windows.groupBy("part").applyInArrow(_covers, _COVER).groupBy("chunk").applyInArrow(_gathered, "sig long, starts binary")
    covers = covers.groupBy("sig").agg(F.first("starts").alias("starts"))  # repeated rows have the same ones
    joined = signed.join(covers.hint("shuffle_hash"), "sig", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS i FROM win JOIN first USING (g) WHERE first.d < win.doc_id),
each AS (SELECT w.doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i), '') AS t
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

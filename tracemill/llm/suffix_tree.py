"""Operator 5: language-model scoring by a probabilistic suffix tree.

A text is a sequence of tokens: lower-cased words, then one end. A token's context is up to WORDS tokens before it, the
beginning of the text included. Without a context its probability is that of its count, smoothed (Witten-Bell) by a tree
over bytes, which spells a token byte by byte, from a mark that begins it to one that ends it; the end of the text is a
symbol that follows the beginning mark alone. So every text has a probability, also with words that were never seen.
There a context is up to DEPTH symbols of the token so far.

In both trees, contexts of LEAST training positions are candidates; one is kept where its next-symbol distribution
diverges from its suffix's by more than the cost of its parameters, and so are its suffixes; those of one byte always
are. Distributions are smoothed by the suffix's (Witten-Bell), in the bytes down to the uniform one. A token or symbol is
scored in the longest kept suffix of what stands before it.

No tree is ever in one place. All positions with the same word before them, or the same nearest two bytes, meet in one
task, with all longer contexts that end in them: there these contexts are counted, tested, smoothed and looked up. The
driver and all tasks hold what follows a single byte, a table of the alphabet's size. Positions after a word that training
has more than TOGETHER times are dealt to several tasks by the word before it; what follows such a word is counted in each
of these, summed apart, a row per symbol, and given to all of them.

Corpus statistics are exact, over all training documents. Words travel as binary runs, cut by hash range; each range is
merged to a part of the vocabulary, which the tree over bytes is learned from and which is spelled once per distinct word.
What the words have without contexts goes back to the steps they come from, which are read again, and from there to the
positions; a step that is not the same when it is read again is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, fragments, materialize

#: Symbols of a context at most.
DEPTH = 8
#: Candidate contexts have at least so many training positions, whatever the size of the corpus.
LEAST = 32
_END_WORD, _END_TEXT, _BEGIN, _BITS = 256, 257, 258, 9
_ALPHABET = 258
_STEP_BYTES = 4_000_000
#: Training positions after one word that stay together; those after a commoner word are dealt by the word before it.
TOGETHER = 1_000_000
#: Positions of a task that are counted and tested at once, if they stand after more than one word.
_AT_ONCE = 200_000
#: Words before a word that are its context at most.
WORDS = 2
#: Numbers of tokens: the beginning of a text, its end, and words from here on; and what stands for no token.
_FIRST, _END, _NUMBERS, _NONE = 0, 1, 2, (1 << 32) - 1
#: Instead of the probability of a word that training lacks, which may be too small for a float: all its other factors do not depend on it.
_UNSEEN = 1e-30

_RUN = "part int, chunk long, sign long, hashes binary, words binary, lengths binary, counts binary"


def _binary(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _pack(x: np.ndarray) -> bytes:
    """An array for the way: its bytes by significance, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _steps(batches: Iterator[pa.RecordBatch]):
    """The steps of a task's documents: number, batch, words, the distinct words' hashes, where each first stands, which one each token is."""
    for number, (batch, data, offsets) in enumerate(W.steps(batches, step_bytes=_STEP_BYTES)):
        words = W.split(data, offsets, lower=True)
        yield (batch.column("task")[0].as_py() << 24) + number, batch, words, *np.unique(W.hashes(words), return_index=True, return_inverse=True)


def _runs(parts: int):
    """documents -> for each step of a task and hash range its distinct words, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, words, keys, first, token in _steps(batches):
            trained = ~np.asarray(batch.column("held_out"))
            count = np.bincount(token, trained[words.texts()], minlength=len(keys)).astype(np.uint32)
            start, length = words.starts[first], words.ends[first] - words.starts[first]
            skip = np.repeat(start - (np.cumsum(length) - length), length)
            spelled = words.data[skip + np.arange(len(skip))]
            edge = np.concatenate([[0], np.cumsum(length)])
            cut = W.ranges(keys, parts)
            rows = []
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    rows.append((p, chunk, int(keys[a:b].sum().view(np.int64)), _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(spelled[edge[a] : edge[b]]), _pack(length[a:b].astype(np.uint32)), _pack(count[a:b])))
            yield _binary(rows, _RUN)

    return run


_META = "part int, chunk long, sign long, numbers binary, counts binary, logs binary, ids binary, tokens binary"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """documents, read again -> for each step its documents and tokens, with the sum of its words' hashes."""
    for chunk, batch, words, keys, _, token in _steps(batches):
        ids = batch.column("doc_id")
        meta = np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int64), np.asarray(batch.column("held_out")).astype(np.int64), np.diff(words.first)])
        yield _binary([(None, chunk, int(keys.sum(dtype=np.uint64).view(np.int64)), None, None, None, meta.tobytes(), _pack(token.astype(np.uint16 if len(keys) <= 1 << 16 else np.uint32)))], _META)


_PART = "part int, chunk long, sign long, places binary, words binary, lengths binary, counts binary, tokens long, known long"


def _merged(rows: pa.Table) -> pa.Table:
    """All runs of one hash range -> a row with its words, each once, with their training counts, and for each run its words' places among them."""
    got = rows.to_pylist()
    hashes = [np.cumsum(_unpack(r["hashes"], np.uint64), dtype=np.uint64) for r in got]
    h = np.concatenate(hashes)
    lengths, counts = (np.concatenate([_unpack(r[c], np.uint32) for r in got]) for c in ("lengths", "counts"))
    spelled = np.concatenate([_unpack(r["words"], np.uint8) for r in got])
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    count = np.add.reduceat(counts[by].astype(np.int64), first)
    own = by[first]
    keys, length = h[own], lengths[own].astype(np.int64)
    skip = np.repeat(start[own] - (np.cumsum(length) - length), length)
    part = got[0]["part"]
    out = [(part, None, None, None, _pack(spelled[skip + np.arange(len(skip))]), _pack(lengths[own]), _pack(count), int(count.sum()), int((count > 0).sum()))]
    out += [(part, r["chunk"], r["sign"], _pack(np.diff(np.searchsorted(keys, x), prepend=0).astype(np.uint32)), *[None] * 5) for r, x in zip(got, hashes, strict=True)]
    return pa.Table.from_batches([_binary(out, _PART)])


def _symbols(words: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all words, begin and end marks included; for each its place in its word; where the words begin."""
    length = _unpack(lengths, np.uint32).astype(np.int64) + 2
    start = np.cumsum(length) - length
    out = np.full(int(length.sum()), -1, np.int64)
    out[start], out[start + length - 1] = _BEGIN, _END_WORD
    out[out < 0] = _unpack(words, np.uint8)
    return out, np.arange(len(out)) - np.repeat(start, length), start


def _after_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the vocabulary -> how often each symbol follows each other one: as many rows as pairs of symbols at most."""
    for batch in batches:
        for row in batch.to_pylist():
            symbols, place, start = _symbols(row["words"], row["lengths"])
            weight = np.repeat(_unpack(row["counts"], np.int64), np.diff(start, append=len(symbols)))
            at = np.flatnonzero((place >= 1) & (weight > 0))
            pair, where = np.unique(symbols[at - 1] << _BITS | symbols[at], return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, where, weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def _pairs(vocabulary: DataFrame, texts_: int) -> np.ndarray:
    """The smoothed probability of each symbol after each other one; texts_ training texts end."""
    counts = np.zeros((_BEGIN + 1, _ALPHABET))
    for r in vocabulary.select("words", "lengths", "counts").mapInArrow(_after_one, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair >> _BITS, r.pair & (1 << _BITS) - 1] = r.n
    counts[_BEGIN, _END_TEXT] = texts_
    root = counts.sum(axis=0)
    kinds = np.count_nonzero(root) or 1
    root = (root + kinds / _ALPHABET) / (root.sum() + kinds)
    kinds = np.count_nonzero(counts, axis=1)[:, None]
    return np.where(kinds > 0, (counts + kinds * root) / np.maximum(counts.sum(axis=1)[:, None] + kinds, 1), root)


class Given(NamedTuple):
    """What is known of a context of the first level of which not all positions are there: its symbols in rising order with their counts, and its sums."""

    symbols: np.ndarray
    counts: np.ndarray
    total: float
    kinds: float
    gain: float


def in_contexts(symbol: np.ndarray, weight: np.ndarray, contexts: list[np.ndarray], below: np.ndarray, given: dict[int, Given] | None = None) -> np.ndarray:
    """The probability of each position's symbol in its longest kept context.

    contexts has for each level what a position's context gets ahead of the level before, below 2^32, or -1 where its text
    has no more; below is the symbol's probability without any of them. Positions of weight 0 are scored and not counted.
    All positions of a context of the first level must be there, but for those that are given; of these, all of a context
    of the second level.
    """
    out, p = below.copy(), below.copy()
    at, group = np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int32)
    levels = []
    for depth, own in enumerate(contexts):
        more = own[at] >= 0
        at, group = at[more], group[more]
        if not len(at):
            break
        key = group.astype(np.int64) << 32 | own[at]
        by = np.lexsort((symbol[at], key))
        at, key, group, x = at[by], key[by], group[by], symbol[at][by]
        del by
        new = np.concatenate([[True], key[1:] != key[:-1]])
        pair = np.concatenate([[True], new[1:] | (x[1:] != x[:-1])])
        first = np.flatnonzero(pair)
        node = np.cumsum(new, dtype=np.int32) - 1
        begin = np.flatnonzero(new)
        holder, parent = node[first], group[begin]
        n = np.add.reduceat(weight[at], first, dtype=np.int64).astype(float)
        total, kinds = np.bincount(holder, n), np.bincount(holder, n > 0).astype(float)
        elsewhere = []
        if given and not depth:
            for i in np.flatnonzero(np.isin(key[begin], list(given))).tolist():
                known = given[int(key[begin[i]])]
                a, b = np.searchsorted(holder, [i, i + 1])
                where = np.minimum(np.searchsorted(known.symbols, x[first[a:b]]), max(len(known.symbols) - 1, 0))
                n[a:b] = np.where(known.symbols[where] == x[first[a:b]], known.counts[where], 0) if len(known.symbols) else 0
                total[i], kinds[i] = known.total, known.kinds
                elsewhere.append((i, known.gain))
        shorter = p[at[first]]
        gain = gains(n, total[holder], shorter, holder, len(total))
        for i, known in elsewhere:
            gain[i] = known
        enough = total >= LEAST
        kept = enough & (gain > 0.5 * kinds * np.log(np.maximum(total, 1)))
        longer = (n + kinds[holder] * shorter) / np.maximum(total[holder] + kinds[holder], 1)
        stay = enough[node]
        p[at[stay]] = longer[np.cumsum(pair, dtype=np.int32) - 1][stay]
        at, group = at[stay], node[stay]
        levels.append((at, group, kept, parent, p[at]))
    for (_, _, kept, parent, _), (_, _, above, _, _) in zip(levels[:0:-1], levels[-2::-1], strict=True):
        above[parent[kept]] = True  # all suffixes of a kept context are kept
    for at, group, kept, _, found in levels:
        out[at[kept[group]]] = found[kept[group]]
    return out


def gains(n: np.ndarray, total: np.ndarray, shorter: np.ndarray, holder: np.ndarray, holders: int) -> np.ndarray:
    """For each holder the log-likelihood that its own distribution gains over the shorter context's, over pairs of a holder and a symbol."""
    seen = n > 0
    return np.bincount(holder[seen], n[seen] * np.log(n[seen] / total[seen] / shorter[seen]), minlength=holders)


_SPELLED = "part int, home int, windows binary, weights binary"


def _windows(parts: int, words: bytes, lengths: bytes, counts: bytes):
    """The distinct windows of a part of the vocabulary, a symbol and the DEPTH before it, in order by range of the nearest two.

    Returns the windows, nearest symbol first, as bytes that stand in no word (0x20 the marks, 0x09 no symbol); their training
    counts; where each range begins; the words' symbols behind two others, each with the number of its window; where words begin.
    """
    symbols, place, start = _symbols(words, lengths)
    at = np.flatnonzero(place > 1)
    code = np.where(symbols < 256, symbols, 0x20).astype(np.uint8)
    key = np.zeros(len(at), np.uint64)
    for k in range(DEPTH + 1):
        far = place[at] < k
        key = W.mix(key * np.uint64(31) + np.where(far, 9, code[at - np.where(far, 0, k)]).astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    own = at[first]
    windows = np.stack([np.where(place[own] < k, np.uint8(9), code[own - np.minimum(k, place[own])]) for k in range(DEPTH + 1)])
    part = (W.mix(windows[1].astype(np.uint64) << np.uint64(8) | windows[2].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((windows[0], windows[4], windows[3], windows[2], windows[1], part))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    which = rank[which]
    weight = np.zeros(len(by), np.int64)
    np.add.at(weight, which, np.repeat(_unpack(counts, np.int64), np.diff(start, append=len(symbols)))[at])
    return windows[:, by], weight, np.searchsorted(part[by], np.arange(parts + 1)), (symbols, at, which), start


def _spelled(parts: int):
    """A part of the vocabulary -> its windows by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                windows, weight, cut, _, _ = _windows(parts, row["words"], row["lengths"], row["counts"])
                yield _binary([(p, row["part"], _pack(windows[:, a:b].ravel()), _pack(weight[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a], _SPELLED)

    return run


_LOGS = "part int, home int, logs binary"


def _grown(pairs):
    """All windows that end in some contexts -> the tree of these contexts, and for each part of the vocabulary what its windows get."""

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        windows = np.concatenate([_unpack(r["windows"], np.uint8).reshape(DEPTH + 1, -1) for r in got], axis=1)
        weight = np.concatenate([_unpack(r["weights"], np.int64) for r in got])
        symbol, near = windows[0].astype(np.int16), windows[1].astype(np.int64)
        symbol[symbol == 0x20] = _END_WORD
        levels = [near << 8 | windows[2], *(np.where(windows[k] == 9, -1, windows[k].astype(np.int64)) for k in range(3, DEPTH + 1))]
        logs = np.log10(in_contexts(symbol, weight, levels, pairs.value[near, symbol])).astype(np.float32)
        cut = np.cumsum([0, *(int.from_bytes(r["weights"][:8], "little") for r in got)])
        return pa.Table.from_batches([_binary([(r["part"], r["home"], _pack(logs[a:b])) for r, a, b in zip(got, cut[:-1], cut[1:], strict=True)], _LOGS)])

    return run


def _shares(parts: int, numbers: dict[int, int], pairs):
    """A part of the vocabulary with its windows' logs, and all its runs' places -> for each step its words' numbers, counts and spellings."""

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        own = next(r for r in got if r["words"] is not None)
        count = _unpack(own["counts"], np.int64)
        _, _, _, (symbols, at, which), start = _windows(parts, own["words"], own["lengths"], own["counts"])
        each = np.zeros(len(symbols))
        each[start + 1] = np.log10(pairs.value[_BEGIN, symbols[start + 1]])
        found = [_unpack(r["logs"], np.float32) for r in sorted((r for r in got if r["logs"] is not None), key=lambda r: r["range"])]
        if found:
            each[at] = np.concatenate(found)[which]
        logs = np.add.reduceat(each, start)
        del symbols, at, which, each, found
        out = []
        for row in got:
            if row["chunk"] is not None:
                at = np.cumsum(_unpack(row["places"], np.uint32), dtype=np.int64)
                out.append((row["part"], row["chunk"], row["sign"], _pack(np.diff(at, prepend=-numbers[row["part"]]).astype(np.uint32)), _pack(count[at]), _pack(logs[at].astype(np.float32)), None, None))
        return pa.Table.from_batches([_binary(out, _META)])

    return run


_PLACE = "part int, chunk long, first binary, second binary, numbers binary, below binary, trained binary, places binary, common binary, ids binary, sums binary"


def _counts(rows: pa.Table) -> pa.Table:
    """A part of the vocabulary, and all its runs' places -> for each step its words' counts."""
    got = rows.to_pylist()
    count = _unpack(next(r for r in got if r["chunk"] is None)["counts"], np.int64)
    out = [(r["part"], r["chunk"], r["sign"], None, _pack(count[np.cumsum(_unpack(r["places"], np.uint32), dtype=np.int64)]), None, None, None) for r in got if r["chunk"] is not None]
    return pa.Table.from_batches([_binary(out, _META)])


def _step(rows: pa.Table) -> tuple[dict, list[dict]]:
    """One step's own row, and its shares by part."""
    got = sorted(rows.to_pylist(), key=lambda r: -1 if r["part"] is None else r["part"])
    meta = got.pop(0)
    if meta["part"] is not None or (meta["sign"] - sum(r["sign"] for r in got)) % (1 << 64):
        raise ValueError("the documents were not the same when they were read again")
    return meta, got


def _bases(rows: pa.Table) -> pa.Table:
    """All shares of one step -> a row for each of its documents, with what needs no tree."""
    meta, got = _step(rows)
    ids, valid, held, n = np.frombuffer(meta["ids"], np.int64).reshape(4, -1)
    count = np.concatenate([np.empty(0, np.int64), *(_unpack(r["counts"], np.int64) for r in got)])
    token = _unpack(meta["tokens"], np.uint16 if len(count) <= 1 << 16 else np.uint32)
    text = np.repeat(np.arange(len(n)), n)
    known, bases = (np.bincount(text, x[token], minlength=len(n)) for x in (count > 0, np.log10(count + 0.5)))
    return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "held_out": pa.array(held == 1), "n_tokens": pa.array(n), "n_known": pa.array(np.rint(known).astype(np.int64)), "base_sum": pa.array(bases.astype(float))})


def _places(parts: int, end: float, total: int, v: int, train: int, together: int):
    """All shares of one step -> its positions by part of the word before, and a row for its documents with what they have without contexts.

    Positions after a word that training has more than `together` times are dealt by the word before that.

    A word that training has fewer than LEAST times makes no context, nor does a pair of words with one: what stands
    after such a word is scored here, and travels not; where only the second word before is one, it is left out.
    """

    def run(rows: pa.Table) -> pa.Table:
        meta, got = _step(rows)
        held, n = np.frombuffer(meta["ids"], np.int64).reshape(4, -1)[2:]
        number = np.concatenate([np.empty(0, np.int64), *(np.cumsum(_unpack(r["numbers"], np.uint32), dtype=np.int64) for r in got)])
        count, logs = (np.concatenate([np.empty(0, t), *(_unpack(r[c], t) for r in got)]).astype(k) for c, t, k in (("counts", np.int64, np.int64), ("logs", np.float32, float)))
        below = np.where(count > 0, (count + v * 10**logs) / max(total + v, 1), _UNSEEN).astype(np.float32)
        rest = np.where(count > 0, 0.0, logs - math.log10(_UNSEEN) + (math.log10(v / (total + v)) if v else 0.0))
        token = _unpack(meta["tokens"], np.uint16 if len(number) <= 1 << 16 else np.uint32)
        text = np.repeat(np.arange(len(n)), n)
        sums = np.stack([np.bincount(text, x[token], minlength=len(n)) for x in (count > 0, np.log10(count + 0.5), rest)])
        # each text with its beginning and its end, as places among the step's distinct words and these two
        number, count, below = np.append(number, [_END, _FIRST]), np.append(count, [0, train]), np.append(below, np.float32([end, 1]))
        often = count >= LEAST
        start = np.cumsum(n + 2) - (n + 2)
        flow = np.full(int((n + 2).sum()), len(number) - 2, np.int32)
        flow[start] = len(number) - 1
        flow[np.arange(len(token)) + 2 * text + 1] = token
        holder = np.repeat(np.arange(len(n)), n + 2)
        at = np.delete(np.arange(len(flow)), start)
        far = ~often[flow[at - 1]]
        sums[2] += np.bincount(holder[at[far]], np.log10(below[flow[at[far]]].astype(float)), minlength=len(n))
        at = at[~far]
        first = number[flow[at - 1]]
        before = flow[at - 2]
        second = np.where((at > start[holder[at]] + 1) & often[before], number[before], _NONE)
        deals = (count // together + 1)[flow[at - 1]]
        part = _dealt(first, W.mix(np.where(second != _NONE, second, number[flow[at]]).astype(np.uint64)) % deals.astype(np.uint64), parts)
        by = np.lexsort((number[flow[at]], part << 32 | first))
        at, first, second, part, deals = at[by], first[by], second[by], part[by], deals[by]
        out = [(meta["chunk"] % parts, meta["chunk"], *[None] * 7, meta["ids"], sums.tobytes())]
        cut = np.searchsorted(part, np.arange(parts + 1))
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                own, x = holder[at[a:b]], flow[at[a:b]]
                known, where = np.unique(number[x], return_index=True)
                columns = (np.diff(first[a:b], prepend=0).astype(np.uint32), second[a:b].astype(np.uint32), np.diff(number[x], prepend=0).astype(np.uint32), below[x[where]])
                common, where = np.unique(first[a:b][deals[a:b] > 1], return_index=True)
                common = np.stack([common, deals[a:b][deals[a:b] > 1][where]]).tobytes() if len(common) else None
                out.append((p, meta["chunk"], *map(_pack, columns), np.packbits(held[own] == 0).tobytes(), _pack(own.astype(np.uint16)), common, None, None))
        return pa.Table.from_batches([_binary(out, _PLACE)])

    return run


def _dealt(first: np.ndarray, deal: np.ndarray, parts: int) -> np.ndarray:
    """The part of the positions after a word, of one deal."""
    return (W.mix(W.mix(first.astype(np.uint64)) + deal.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


class _Positions(NamedTuple):
    first: np.ndarray
    second: np.ndarray
    number: np.ndarray
    below: np.ndarray
    weight: np.ndarray
    cut: np.ndarray


def _positions(got: list[dict]) -> _Positions:
    """The positions of some rows; cut: where those of each row begin, and one more at the end."""
    first, number = (np.concatenate([np.cumsum(_unpack(r[c], np.uint32), dtype=np.uint32) for r in got]) for c in ("first", "numbers"))
    second = np.concatenate([_unpack(r["second"], np.uint32) for r in got])
    length = [int.from_bytes(r["places"][:8], "little") for r in got]
    cut = np.cumsum([0, *length])
    below = np.concatenate([_unpack(r["below"], np.float32)[np.unique(number[a:b], return_inverse=True)[1]] for r, a, b in zip(got, cut[:-1], cut[1:], strict=True)])
    weight = np.concatenate([np.unpackbits(np.frombuffer(r["trained"], np.uint8), count=m) for r, m in zip(got, length, strict=True)])
    return _Positions(first, second, number, below, weight, cut)


_FOLLOW = "first long, deals long, symbols binary, counts binary, below binary"


def _follow(rows: pa.Table) -> pa.Table:
    """Positions of a part -> for each word that is dealt to several parts what follows it in this one in training."""
    got = [r for r in rows.to_pylist() if r["common"] is not None]
    out = []
    if got:
        x = _positions(got)
        common = dict(np.concatenate([np.frombuffer(r["common"], np.int64).reshape(2, -1) for r in got], axis=1).T.tolist())
        for w in sorted(common):
            own = np.flatnonzero((x.first == w) & (x.weight > 0))
            if len(own):
                symbol, at, n = np.unique(x.number[own], return_index=True, return_counts=True)
                out.append((w, common[w], _pack(np.diff(symbol, prepend=0).astype(np.uint32)), _pack(n.astype(np.int64)), _pack(x.below[own[at]].astype(float))))
    return pa.Table.from_batches([_binary(out, _FOLLOW)])


_LEVEL = "part int, first long, total double, kinds double, gain double, symbols binary, counts binary"


def _level(parts: int):
    """All that follows one common word -> its context, for each of its deals."""

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        symbol, n, below = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0)
        for r in got:  # one after the other, so that no more than two lists are here at once
            every = np.concatenate([symbol, np.cumsum(_unpack(r["symbols"], np.uint32), dtype=np.uint32)])
            more = np.concatenate([n, _unpack(r["counts"], np.int64)])
            below = np.concatenate([below, _unpack(r["below"], float)])
            by = np.argsort(every, kind="stable")
            every = every[by]
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            symbol, n, below = every[at], np.add.reduceat(more[by], at), below[by[at]]
        total = n.sum()
        gain = float(gains(n, np.full(len(n), total), below, np.zeros(len(n), np.int64), 1)[0])
        w, packed = got[0]["first"], (_pack(np.diff(symbol, prepend=0).astype(np.uint32)), _pack(n.astype(np.int64)))
        deal = np.unique(_dealt(np.full(got[0]["deals"], w), np.arange(got[0]["deals"]), parts))
        return pa.Table.from_batches([_binary([(p, w, float(total), float(len(n)), gain, *packed) for p in deal.tolist()], _LEVEL)])

    return run


_READ = "chunk long, places binary, logs binary, ids binary, sums binary"


def _read(rows: pa.Table, common: pa.Table) -> pa.Table:
    """All positions of a part, and the contexts of the common words there -> the tree, and for each step what its documents get."""
    got = rows.drop_columns(["part"]).to_pylist()
    out = [(r["chunk"], None, None, r["ids"], r["sums"]) for r in got if r["ids"] is not None]
    got = [r for r in got if r["ids"] is None]
    if got:
        given = {r["first"]: Given(np.cumsum(_unpack(r["symbols"], np.uint32), dtype=np.uint32), _unpack(r["counts"], np.int64), r["total"], r["kinds"], r["gain"]) for r in common.to_pylist()}
        x = _positions(got)
        logs = np.empty(len(x.first), np.float64)
        by = np.argsort(x.first, kind="stable")
        edge = np.flatnonzero(np.diff(x.first[by])) + 1
        at = 0
        while at < len(by):  # the positions after some words at once
            to = int(edge[i]) if (i := int(np.searchsorted(edge, at + _AT_ONCE))) < len(edge) else len(by)
            own = by[at:to]
            second = np.where(x.second[own] == _NONE, -1, x.second[own].astype(np.int64))
            logs[own] = np.log10(in_contexts(x.number[own], x.weight[own], [x.first[own].astype(np.int64), second], x.below[own].astype(float), given))
            at = to
        for r, a, b in zip(got, x.cut[:-1], x.cut[1:], strict=True):
            used, place = np.unique(_unpack(r["places"], np.uint16), return_inverse=True)
            out.append((r["chunk"], _pack(np.diff(used, prepend=np.uint16(0))), _pack(np.bincount(place, logs[a:b])), None, None))
    return pa.Table.from_batches([_binary(out, _READ)])


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _totals(rows: pa.Table) -> pa.Table:
    """All that one step's documents get -> a row for each of them."""
    got = rows.to_pylist()
    meta = next(r for r in got if r["ids"] is not None)
    ids, valid, held, n = np.frombuffer(meta["ids"], np.int64).reshape(4, -1)
    known, bases, score = np.frombuffer(meta["sums"], float).reshape(3, -1).copy()
    for r in got:
        if r["places"] is not None:
            score[np.cumsum(_unpack(r["places"], np.uint16), dtype=np.uint16)] += _unpack(r["logs"], float)
    return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "held_out": pa.array(held == 1), "n_tokens": pa.array(n), "n_known": pa.array(np.rint(known).astype(np.int64)), "base_sum": pa.array(bases), "score": pa.array(score)})


class _Counted(NamedTuple):
    """Documents and their vocabulary: of training, the documents, all tokens and the distinct ones."""

    rows: DataFrame
    merged: DataFrame
    vocabulary: DataFrame
    parts: int
    train: int
    n: int
    v: int


def _counted(docs: DataFrame, folds: int, fold: int) -> _Counted:
    parts = fragments(docs)
    held = F.coalesce(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held.alias("held_out"), F.spark_partition_id().alias("task"))
    train = rows.where(~F.col("held_out")).count()
    merged = materialize(rows.mapInArrow(_runs(parts), _RUN).groupBy("part").applyInArrow(_merged, _PART))
    vocabulary = merged.where("chunk is null").select("part", "words", "lengths", "counts", "tokens", "known")
    total = vocabulary.agg(F.sum("tokens").alias("n"), F.sum("known").alias("v")).first()
    return _Counted(rows, merged, vocabulary, parts, train, (total.n or 0) + train, (total.v or 0) + (train > 0))


def _finished(sums: DataFrame, train: int, n: int, v: int) -> DataFrame:
    """The end of each text is a token too."""
    tokens = F.col("n_tokens") + 1
    base = F.col("base_sum") + math.log10(train + 0.5) - tokens * F.lit(math.log10(n + 0.5 * (v + 1)))
    return sums.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + int(train > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), *(c for c in sums.columns if c == "score"))


def base_scores(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """score_documents without the tree's score: the same vocabulary and counts, and no tree is grown."""
    x = _counted(docs, folds, fold)
    counts = x.merged.select("part", "chunk", "sign", "places", "counts").groupBy("part").applyInArrow(_counts, _META)
    sums = counts.union(x.rows.mapInArrow(_tokens, _META)).groupBy("chunk").applyInArrow(_bases, _RESULT.removesuffix(", score double"))
    return _finished(sums, x.train, x.n, x.v)


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, together: int = TOGETHER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; whatever else it has is ignored. held_out: crc32 of doc_id as text leaves `fold` modulo
    `folds`; a null doc_id is not held out. Tokens are the words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and one end; a null,
    empty or blank text has the end alone. n_known counts tokens that training has; train_tokens is N, all training tokens;
    base_score is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens; score is the tree's log10 probability of
    the text. Repeated rows count each. docs is read twice and must give the same rows in the same order, as files do; else
    it is an error. Positions after a word with more than `together` training positions are dealt to several tasks; the
    result is the same. Without training documents N is 0 and the tree uniform; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows, merged, vocabulary, parts, train, n, v = _counted(docs, folds, fold)
    pairs = _pairs(vocabulary, train)
    end = (train + v * pairs[_BEGIN, _END_TEXT]) / (n + v) if v else pairs[_BEGIN, _END_TEXT]
    pairs = spark.sparkContext.broadcast(pairs)
    spelled = vocabulary.select("part", "words", "lengths", "counts").mapInArrow(_spelled(parts), _SPELLED).groupBy("part").applyInArrow(_grown(pairs), _LOGS)
    numbers, last = {}, _NUMBERS
    for r in vocabulary.select("part", F.substring("lengths", 1, 8).alias("n")).collect():
        numbers[r.part] = last
        last += int.from_bytes(r.n, "little")
    if last >= _NONE:
        raise ValueError("more than 2^32 distinct words")
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    none = F.lit(None).cast("long")
    both = merged.select("part", "chunk", "sign", none.cast("int").alias("range"), "places", "words", "lengths", "counts", *nothing("logs"))
    both = both.union(spelled.select("home", none, none, F.col("part").alias("range"), *nothing("places", "words", "lengths", "counts"), "logs"))
    deals = max(parts, n // (2 * together) + 1)
    shares = both.groupBy("part").applyInArrow(_shares(parts, numbers, pairs), _META)
    places = shares.union(rows.mapInArrow(_tokens, _META)).groupBy("chunk").applyInArrow(_places(deals, float(end), n, v, train, together), _PLACE)
    level = places.groupBy("part").applyInArrow(_follow, _FOLLOW).groupBy("first").applyInArrow(_level(deals), _LEVEL)
    sums = places.groupBy("part").cogroup(level.groupBy("part")).applyInArrow(_read, _READ).groupBy("chunk").applyInArrow(_totals, _RESULT)
    return _finished(sums, train, n, v)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def lm_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5: the tokens and the base score, in six decimals, over the whole table. None of it needs the tree."""
    return base_scores(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


BASES_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 1 AS held_out FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_concat(ws, [NULL])) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 6) AS base_score
FROM t LEFT JOIN c ON c.w IS NOT DISTINCT FROM t.w, n GROUP BY doc_id, held_out
"""

"""Operator 6: byte-level BPE encoding and decoding.

The encoder backtracks: an Aho-Corasick automaton over the vocabulary's byte strings gives the longest token at each
place; a token is taken if the pair with the one before it is compatible, which means that merging by rank would keep
the border between them; else the next shorter token is tried, else the one before is given up. Each place is given up
once at most, so the time is linear, and the ids are those of merging by rank. Decoding gathers token bytes through a
table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts

#: Pieces of text whose ids a worker keeps at hand; it starts anew when there are more.
KEPT_PIECES = 300_000
#: Of so many characters or bytes at most.
KEPT_LENGTH = 256


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary: a printable byte for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """An encoder and decoder for a byte-level BPE file of the tokenizers library without normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_of = _byte_of()
        raw = lambda s: bytes(byte_of[c] for c in s)
        model, pre = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or told["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: rank of the pair, and for each token its two parts; a single byte is its own parts
        self.rank, self.parts, self.order = {}, {}, {}
        for b in range(256):
            if (i := self.id_of.get(bytes([b]))) is not None:
                self.parts[i], self.order[i] = (i, i), -1
        for rank, (a, b) in enumerate(merges):
            left, right = self.id_of[raw(a)], self.id_of[raw(b)]
            both = self.id_of[raw(a) + raw(b)]
            self.rank[left, right] = rank
            if both not in self.parts:
                self.parts[both], self.order[both] = (left, right), rank
        self.bytes_of = {i: s for s, i in self.id_of.items() if i in self.parts} | {i: s.encode() for s, i in self.added.items()}
        self.machine = ahocorasick.Automaton()
        for i in self.parts:
            self.machine.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.machine.make_automaton()
        self.length = {i: len(s) for i, s in self.bytes_of.items()}
        size = max(self.bytes_of) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.ids, self.said = _Kept(self._packed), _Kept(lambda piece: ",".join(map(str, np.frombuffer(self.ids[piece], np.uint32))))

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self.shorter:
            own = self.bytes_of[token]
            self.shorter[token] = next((i for n in range(len(own) - 1, 0, -1) if (i := self.id_of.get(own[:n])) in self.parts), -1)
        return self.shorter[token]

    def _pair(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between these two tokens.

        Undo the merges of both sides, latest first: no pair that met at the border may have a rank before the merge that
        took one of its sides away. On equal terms the left side's merge comes first.
        """
        key = (left, right)
        if (known := self.compatible.get(key)) is None:
            rank, order, parts, limit = self.rank, self.order, self.parts, len(self.rank)
            while True:
                if rank.get((left, right), limit) < limit:
                    known = False
                    break
                if order[left] > order[right]:
                    limit, left = order[left], parts[left][1]
                elif order[right] >= 0:
                    limit, right = order[right] + 1, parts[right][0]
                else:
                    known = True
                    break
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (one := self.id_of.get(piece)) is not None and one in self.parts:
            whole = [one]
            if self._whole(one):
                return whole
        longest = [-1] * len(piece)
        for end, token in self.machine.iter(piece.decode("latin-1")):
            longest[end - self.length[token] + 1] = token
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token >= 0:
                end = at + self.length[token]
                if not dead[end] and (not out or self._pair(out[-1], token)):
                    break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self._shorter(last)
        return out

    @lru_cache(maxsize=None)  # noqa: B019  one entry per token at most
    def _whole(self, token: int) -> bool:
        """Whether merging the token's own bytes by rank gives the token."""
        left, right = self.parts[token]
        return left == right == token or (self._whole(left) and self._whole(right) and self._pair_before(left, right, self.order[token]))

    def _pair_before(self, left: int, right: int, rank: int) -> bool:
        """Whether the border between two tokens stands until the merge of the given rank joins them."""
        a, b, limit = left, right, rank
        while True:
            found = self.rank.get((a, b), len(self.rank))
            if found < limit and (a, b) != (left, right):
                return False
            if self.order[a] > self.order[b]:
                limit, a = self.order[a], self.parts[a][1]
            elif self.order[b] >= 0:
                limit, b = self.order[b] + 1, self.parts[b][0]
            else:
                return True

    def _packed(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode("utf-8")), np.uint32).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and their decimal forms joined by commas."""
        for kept in (self.ids, self.said):
            if len(kept) > KEPT_PIECES:
                kept.clear()
        packed, said, at = [], [], 0
        specials = self.specials.finditer(text) if any(s in text for s in self.added) else ()
        for special in [*specials, None]:
            pieces = self.pieces.findall(text[at : special.start()] if special else text[at:] if at else text)
            packed += map(self.ids.__getitem__, pieces)
            said += map(self.said.__getitem__, pieces)
            if special:
                packed.append(np.uint32(self.added[special[0]]).tobytes())
                said.append(str(self.added[special[0]]))
                at = special.end()
        return np.frombuffer(b"".join(packed), np.uint32), ",".join(said)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in UTF-8; a sequence that is not UTF-8 becomes U+FFFD."""
        ids = ids.astype(np.int64)
        length = self.offsets[ids + 1] - self.offsets[ids]
        skip = np.repeat(self.offsets[ids] - (np.cumsum(length) - length), length)
        raw = self.table[skip + np.arange(len(skip))].tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode("utf-8")
        return raw


class _Kept(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= KEPT_LENGTH:
            self[key] = out
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker and file."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids as array<int>.

    tokenizer is the file's path on every executor. docs needs doc_id and text; whatever else it has is ignored. A null
    text is empty: no tokens, and the digests of the empty string. The strings of added tokens in a text are those
    tokens. Texts are taken whole, one after the other; repeated rows give repeated rows; an empty table an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n, said, decoded, every = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids, joined = own.encode(text or "")
                    n.append(len(ids))
                    said.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(ids.astype(np.int32))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

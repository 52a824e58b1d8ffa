"""Operator 8: token counts by a count-only Viterbi search.

The vocabulary's pieces and scores make a unigram model. An Aho-Corasick automaton enumerates all pieces in a text; at
each end the best score is kept with its number of tokens, and no path. Ties go as in the sentencepiece library: of two
paths of equal score to a place, the one whose last piece starts earlier stays. A character that is no piece of its own
costs the lowest score less 10 and counts a token for each of its bytes (byte fallback).

A text is searched in units: a piece holds the blank mark only at its start, or is a run of marks, so every path has a
border before each mark that follows something else; between those borders the units are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts

MARK = "▁"
#: What an unknown character costs beside the lowest score of the vocabulary.
UNKNOWN = 10.0
#: Lower scores count as this: a file's marks of -10^9 would swallow all others where numbers have 32 bits.
FLOOR = -100_000.0
#: Units whose result a worker keeps at hand; it starts anew when there are more.
KEPT_UNITS = 400_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Counter:
    """Scores and counts by a sentencepiece file with the identity normalizer, a mark before the text and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        told = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score_of: dict[str, float] = {}
        for i in range(told.get_piece_size()):
            if not (told.is_control(i) or told.is_unknown(i) or told.is_unused(i) or told.is_byte(i)):
                self.score_of[told.id_to_piece(i)] = max(told.get_score(i), FLOOR)
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score_of):
            raise ValueError(f"{path} has pieces with a mark inside")
        self.unknown = min(self.score_of.values()) - UNKNOWN
        self.machine = ahocorasick.Automaton()
        for piece, score in self.score_of.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.kept: dict[str, tuple[float, int]] = {}

    def unit(self, text: str) -> tuple[float, int]:
        """The best score of a unit and its tokens."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        matches = self.machine.iter(text)  # by their ends
        end, piece = next(matches, (n, None))
        for at in range(n):
            found = []
            while end == at:
                found.append(piece)
                end, piece = next(matches, (n, None))
            # the longest piece starts first: it stays unless a later start is better
            single = False
            for length, score in sorted(found, reverse=True):
                start = at + 1 - length
                total = best[start] + score
                if best[at + 1] is None or total > best[at + 1]:
                    best[at + 1], count[at + 1] = total, count[start] + 1
                single |= length == 1
            if not single:
                total = best[at] + self.unknown
                if best[at + 1] is None or total > best[at + 1]:
                    best[at + 1], count[at + 1] = total, count[at] + len(text[at].encode("utf-8"))
        return best[n], count[n]

    def text(self, text: str) -> tuple[float, int]:
        """The best score of a whole text and its number of tokens; an empty text has none."""
        if not text:
            return 0.0, 0
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        kept, score, n = self.kept, 0.0, 0
        for unit in _UNIT.findall(MARK + text.replace(" ", MARK)):
            got = kept.get(unit)
            if got is None:
                got = self.unit(unit)
                if len(unit) <= 64:
                    kept[unit] = got
            score += got[0]
            n += got[1]
        return score, n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of docs: doc_id, n_chars (code points), n_tokens, score (the best path's sum of piece scores).

    tokenizer is a sentencepiece file's path on every executor; its pieces and scores are taken as a unigram model. docs
    needs doc_id and text; whatever else it has is ignored. A null text is empty: no tokens, score 0. Texts are taken
    whole; repeated rows give repeated rows; an empty table an empty result. Scores are at least FLOOR, and summed in 64-bit
    numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            rows = []
            for raw in batch.column("text"):
                text = raw.as_py() or ""
                score, n = own.text(text)
                rows.append((len(text), n, score))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64())))], names=["doc_id", "n_chars", "n_tokens", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))

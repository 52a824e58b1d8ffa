"""Operator 2: license scans by an exact set-similarity join of text blocks with license templates.

The tokens of the templates are ordered by their frequency over all blocks of the corpus, rarest first. A block that holds
`percent` of a template's tokens must hold one of the template's |T| - need + 1 rarest (prefix filter), at least need
tokens (length filter), and, from the first common token on, enough tokens on both sides (positional filter); what is
left is counted exactly. The templates are the small side, of a fixed size; the corpus is scanned twice and never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences by which public licenses are recognised, and their labels.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
_SEPARATOR = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PARAGRAPH = re.compile(rb"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n")


def _tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8").lower())


def _blocks(low: bytes) -> Iterator[list[bytes]]:
    """The words of each line, and of each paragraph of several lines. Lines without words may make empty blocks."""
    for paragraph in _PARAGRAPH.split(low):
        lines = [_WORD.findall(line) for line in paragraph.split(b"\n")]
        yield from lines
        if len(lines) > 1:
            yield [w for line in lines for w in line]


def token_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many blocks of all documents each token of the vocabulary stands: as many rows as it has tokens reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                if (raw := text.as_py()) is not None:
                    for words in _blocks(raw.encode("utf-8").lower()):
                        total.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = texts(docs).select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    docs needs doc_id and text; whatever else it has is ignored. A-Z is lower-cased; words are maximal runs of letters,
    digits and all beyond ASCII; a null text is empty: no words, empty labels, score 0, null places. n_base counts the
    places where the words of one of PHRASES stand one after the other, first_word and last_word are their smallest and
    largest start. A block is a line or a paragraph. A template is found in a block that holds at least percent / 100 of
    the template's distinct words; labels are those of phrases, and of the template of which a block holds the largest share,
    of several the one with the most words in common (ties: all); n_blocks counts the pairs of a block
    and a template found in it; score is the largest share of a template that a block holds among those, 1 with a phrase,
    0 with neither. Repeated rows give repeated rows; an empty table gives an empty result. templates are to be some
    hundreds at most: they go to every task.
    """
    sets = [(label, frozenset(_tokens(text))) for label, text in templates]
    vocabulary = frozenset().union(*(t for _, t in sets)) if sets else frozenset()
    frequency = token_frequencies(docs, set(vocabulary))
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    need = [-(-percent * len(t) // 100) for _, t in sets]
    ranked = [sorted(order[w] for w in t) for _, t in sets]
    place = [{w: i for i, w in enumerate(r)} for r in ranked]
    holders: dict[int, list[int]] = {}
    for i, r in enumerate(ranked):
        for w in r[: len(r) - need[i] + 1]:
            holders.setdefault(w, []).append(i)
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    known = set(order)

    def found(words: list[bytes]) -> Iterator[tuple[int, int]]:
        own = known.intersection(words)
        if not own:
            return
        mine = sorted(order[w] for w in own)
        seen = set()
        for j, w in enumerate(mine):
            for i in holders.get(w, ()):
                if i in seen:
                    continue
                seen.add(i)
                if len(mine) < need[i] or min(len(mine) - j, len(ranked[i]) - place[i][w]) < need[i]:
                    continue
                overlap = len(place[i].keys() & mine)
                if overlap >= need[i]:
                    yield i, overlap

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("text"):
                low = (raw.as_py() or "").encode("utf-8").lower()
                labels, best, blocks, n = set(), 0.0, 0, 0
                for paragraph in _PARAGRAPH.split(low):
                    lines = [_WORD.findall(line) for line in paragraph.split(b"\n")]
                    n += sum(map(len, lines))
                    for words in [*lines, [w for line in lines for w in line]] if len(lines) > 1 else lines:
                        hits = [(overlap / len(ranked[i]), overlap, sets[i][0]) for i, overlap in found(words)]
                        if hits:
                            top = max(hits)[:2]
                            labels.update(label for *own, label in hits if tuple(own) == top)
                            best, blocks = max(best, top[0]), blocks + len(hits)
                starts, base = [], set()
                if any(p[0] in low and p[-1] in low for p, _ in phrases):
                    words = _WORD.findall(low)
                    for phrase, label in phrases:
                        at = -1
                        while True:
                            try:
                                at = words.index(phrase[0], at + 1)
                            except ValueError:
                                break
                            if words[at : at + len(phrase)] == phrase:
                                starts.append(at)
                                base.add(label)
                say = lambda x: ",".join(sorted(x))
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), say(base), say(base | labels), 1.0 if base else best, blocks))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"])

    return texts(docs).mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _oracle() -> str:
    words = rf"[^{_SEPARATOR}]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda text: ", ".join(f"'{w.decode()}'" for w in sorted(set(_tokens(text))))
    listed = ", ".join(f"('{label}', [{quoted(text)}])" for label, text in TEMPLATES)
    hits = "\n  UNION ALL ".join(
        "SELECT doc_id, i - 1 AS i, '{}' AS label FROM every WHERE {}".format(label, " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split()))) for phrase, label in PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, {low} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{words}') AS ws FROM d),
every AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hit AS ({hits}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM hit GROUP BY doc_id),
p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[{_SEPARATOR}]*\n')) AS p FROM d),
b AS (SELECT doc_id, unnest(string_split(p, chr(10))) AS b FROM p UNION ALL SELECT doc_id, p FROM p WHERE contains(p, chr(10))),
bw AS (SELECT doc_id, row_number() OVER () AS block, list_distinct(regexp_extract_all(b, '{words}')) AS ws FROM b),
tpl(label, ts) AS (VALUES {listed}),
m AS (SELECT doc_id, label, len(list_intersect(ts, ws))::DOUBLE / len(ts) AS score, rank() OVER (PARTITION BY block ORDER BY len(list_intersect(ts, ws))::DOUBLE / len(ts) DESC, len(list_intersect(ts, ws)) DESC) AS place FROM bw, tpl WHERE 100 * len(list_intersect(ts, ws)) >= 80 * len(ts)),
found AS (SELECT doc_id, max(score) AS score, count(*) AS n FROM m GROUP BY doc_id),
labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (base = 1) AS base_labels
  FROM (SELECT doc_id, label, max(base) AS base FROM (SELECT doc_id, label, 1 AS base FROM hit UNION ALL SELECT doc_id, label, 0 FROM m WHERE place = 1) GROUP BY ALL) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.score, 0.0) END::DOUBLE AS score, coalesce(found.n, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


ORACLE = _oracle()

"""Operator 4: secret scans with corpus-wide ownership frequency.

Candidates of every text are hashed; over the corpus the hashes are counted by distinct owners and repositories. What
several owners or many repositories have is a widely copied example; what is left may be live. The base kinds are always
reported; of the further candidates (vendor tokens and words of high entropy) only what is not widely copied.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

#: Kinds of spans in the order of the listing; the first three are the base.
KINDS = ["assign", "access", "hex", "vendor", "entropy"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYS = ("passw", "secret", "token", "api")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
_ENTROPY = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Bits per character and kinds of characters from which on a word counts as random.
ENTROPY_BITS = 3.5
_SPAN = "array<struct<kind:int,start:long,end:long,hash:string>>"
_SCAN = f"row long, doc_id long, sig long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans {_SPAN}"


def _random(word: str) -> bool:
    kinds = sum(bool(re.search(c, word)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    if kinds < 3:
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= ENTROPY_BITS


class _Taken:
    """Spans, in which overlaps are looked up by bisection."""

    def __init__(self, spans: list[tuple[int, int, int, str]]):
        own = sorted((x[1], x[2]) for x in spans)
        self.starts, self.ends = [a for a, _ in own], list(accumulate((b for _, b in own), max))

    def free(self, span: tuple[int, int, int, str]) -> bool:
        """Whether none of them overlaps it."""
        i = bisect_left(self.starts, span[2])
        return not i or self.ends[i - 1] <= span[1]


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """All candidates of a text: kind's number, start, end (code points, end exclusive) and the secret itself, by start, then kind.

    Further candidates that overlap a base span, or an earlier further one, are left out.
    """
    base = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        base += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = [m.span() for m in _LONG.finditer(text)]
    for a, b in runs:
        base += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text, a, b)]
        base += [(2, *m.span(), m[0]) for m in _HEX.finditer(text, a, b)]
    taken, more = _Taken(base), []
    for a, b in runs:
        vendor = [x for m in _VENDOR.finditer(text, a, b) if taken.free((x := (3, *m.span(), m[0])))]
        own = _Taken(vendor)
        more += vendor
        more += [x for m in _ENTROPY.finditer(text, a, b) if _random(m[0]) and taken.free((x := (4, *m.span(), m[0]))) and own.free(x)]
    return sorted(base + more, key=lambda x: (x[1], x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans = [], [], []
        for text in batch.column("text"):
            got = candidates(text.as_py() or "")
            counts.append([sum(x[0] == k for x in got) for k in range(3)])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in got if k < 3).encode()).hexdigest())
            spans.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(s.encode()).hexdigest()} for k, a, b, s in got])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))
        cols = [batch.column(c) for c in ("row", "doc_id", "sig", "owner", "repo")] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)] + [pa.array(digests, pa.string()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=[x.strip().split()[0] for x in "row, doc_id, sig, owner, repo, n_assign, n_access, n_hex, base_sha256, spans".split(",")])


def signature(docs: DataFrame) -> F.Column:
    """A 64-bit hash of a row's doc_id and text, by which spans are matched with texts."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["doc_id"].isNull(), docs["text"].isNull())


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), owners: int = 2, repositories: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, sig, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_owners, n_repos, marks.

    docs needs doc_id, text and the columns named as owner and repository; whatever else it has is ignored. A null owner
    or repository is one of its own. A null text is empty: no spans, and the digest of the empty string. base_sha256 is
    over kind:start:end of the base spans, spans the same listing of those and of each further candidate whose hash fewer
    than `owners` owners and fewer than `repositories` repositories have, in code points, by start, then kind. n_owned and
    n_copied count the candidates, base ones included, on either side of these bounds; n_owners and n_repos are the most
    owners and repositories that one of the row's hashes has, 0 without candidates. marks are the spans as structs of start and end. sig is signature(docs).
    Repeated rows are rows of their own; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("\0"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), signature(docs).alias("sig"),
        text(owner).alias("owner"), F.concat_ws("\1", *(text(c) for c in repository)).alias("repo"),
    )
    scanned = materialize(rows.mapInArrow(_scan, _SCAN))
    each = scanned.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    # counted step by step, so that a hash which a third of all rows have is folded before it moves
    shared = each.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    shared = shared.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    judged = each.join(shared, "hash").withColumn("copied", (F.col("n_owners") >= owners) | (F.col("n_repos") >= repositories))
    reported = F.when((F.col("kind") < 3) | ~F.col("copied"), F.struct("start", "kind", "end"))
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(reported)).alias("all"), F.count_if(~F.col("copied")).alias("n_owned"), F.count_if("copied").alias("n_copied"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    names = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    out = scanned.drop("spans").join(listed, "row", "left")
    return out.select(
        "doc_id", "sig", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(said, F.lit("")).alias("spans"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_owners", F.lit(0)).alias("n_owners"), F.coalesce("n_repos", F.lit(0)).alias("n_repos"),
        F.coalesce(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<start:long,end:long>>")).alias("marks"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).drop("sig", "marks")


def secret_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4: the base spans, over the whole table."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


BASES_ORACLE = r"""
WITH k AS (SELECT * FROM (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', ''), (2, 'hex', '')) AS k(number, kind, expr)),
m AS (SELECT doc_id, 0 AS number, regexp_extract_all(text, (SELECT expr FROM k WHERE number = 0)) AS m, regexp_extract_all(text, (SELECT expr FROM k WHERE number = 0), 2) AS g, string_split_regex(text, (SELECT expr FROM k WHERE number = 0)) AS p FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_extract_all(text, '[0-9a-f]{32,}'), string_split_regex(text, '[0-9a-f]{32,}') FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, number, list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(g[i]) AS own FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT doc_id, number, a::BIGINT AS a, (a + n)::BIGINT AS b, (SELECT kind FROM k WHERE k.number = s.number) AS kind FROM s WHERE own >= CASE number WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
c AS (SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, number) AS said FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM documents d LEFT JOIN c USING (doc_id)
"""

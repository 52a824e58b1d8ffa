"""Operator 9: exact n-gram Jaccard join by vertical partitioning.

The shingles of all documents have one global order: rising power of two of their document frequency, then hash. It is
cut into fragments, POWERS powers each; a document is cut into segments by them. Only documents that share enough of
their shingles with others can have a partner, and only pairs that share a shingle of both prefixes (the rarest
n - ceil(0.8 n) + 1 of n) can be similar. Of a candidate pair, each fragment's segments are joined and their overlap is
counted on its own, a row for each pair and fragment; the partial counts are summed per pair, and
100 * overlap >= percent * union is tested in whole numbers.

Document frequencies come from all shingles of all documents. They travel as sorted binary runs, cut by hash range, and
return to their documents the same way; a shingle that many documents hold costs ten bytes per holder there, and no
pairs.

Candidates never are all pairs of a group. Documents with equal sets are one class. In each group of classes that share
a prefix shingle, members are first tested against one leader, the one whose shingles are the most frequent. Links that
hold make components; only members of different components of a group are tested on, against a second leader, and then
against each other. Every such pair has to pass the positional bound where it meets: a pair that meets at its first
common shingle can have no more in common than what either has from there on, so similar pairs pass at that place. A
group of near copies costs as many tests as it has members, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, fragments, materialize, texts
from .links import components

#: So many powers of two of the document frequency make a fragment.
POWERS = 3

_RUN = "part int, chunk long, hashes binary, places binary, counts binary, ids binary"
_SET = "uid long, doc_id long, n long, sum1 long, sum2 long, weight double, prefix array<long>, prefix_at array<int>, alone int, shared array<long>, cut array<int>"


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: hashes in rising order, and their texts' numbers."""
    words = W.split(data, offsets, lower=True)
    h = W.hashes(words)
    s, whole = W.shingles(h, words.first, k)
    text = words.texts()
    n = np.diff(words.first)
    extra, extra_text = [], []
    for t in np.flatnonzero((n > 0) & (n < k)):  # fewer words: the whole sequence is the one shingle
        own = h[words.first[t] : words.first[t + 1]]
        extra.append(W.mix((own * W.powers(k + 1)[1 : len(own) + 1]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(own))))
        extra_text.append(t)
    s, text = s[whole], text[whole]
    if extra:
        s, text = np.concatenate([s, *extra]), np.concatenate([text, np.array(extra_text, text.dtype)])
        by = np.argsort(text, kind="stable")
        s, text = s[by], text[by]
    by = np.argsort(s, kind="stable")
    s, text = s[by], text[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return s[new], text[new].astype(np.uint16)


def _runs(k: int, parts: int):
    """documents -> a row for each step of a task and hash range, and one (part -1 - its range) for the step's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch, data, offsets in W.steps(batches):
            s, text = _shingle_sets(data, offsets, k)
            m = len(batch)
            n = np.bincount(text, minlength=m).astype(np.int64)
            by = np.argsort(text, kind="stable")
            cum = [np.concatenate([[np.uint64(0)], np.cumsum(x[by], dtype=np.uint64)]) for x in (s, W.mix(s + np.uint64(1)))]
            edge = np.concatenate([[0], np.cumsum(n)])
            sums = [(c[edge[1:]] - c[edge[:-1]]).view(np.int64) for c in cum]
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid()).astype(np.int64)
            meta = np.stack([np.asarray(ids.fill_null(0)), known, n, *sums])
            cut = W.ranges(s, parts)
            rows = [(p, chunk, s[a:b].tobytes(), text[a:b].tobytes(), None, None) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            rows.append((chunk % parts, chunk, None, None, None, meta.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            chunk += 1

    return run


_NAMES = ["part", "chunk", "hashes", "places", "counts", "ids"]
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _frequencies(rows: pa.Table) -> pa.Table:
    """All runs of one hash range -> the same with only the shingles that two documents or more hold, and their frequencies."""
    chunk, ids = rows["chunk"].to_pylist(), rows["ids"].to_pylist()
    got = [(c, np.frombuffer(h, np.uint64), p) for c, h, p in zip(chunk, rows["hashes"].to_pylist(), rows["places"].to_pylist(), strict=True) if h is not None]
    out = [(0, c, None, None, None, i) for c, i in zip(chunk, ids, strict=True) if i is not None]
    if got:
        every = np.concatenate([h for _, h, _ in got])
        every.sort(kind="stable")
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(at, append=len(every))
        keys, count = every[at][count > 1], count[count > 1].astype(np.uint32)
        del every
        for c, h, p in got if len(keys) else ():
            where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[where] == h
            if hit.any():
                out.append((0, c, h[hit].tobytes(), np.frombuffer(p, np.uint16)[hit].tobytes(), count[where[hit]].tobytes(), None))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _prefixes(percent: int):
    """All rows of one step -> a row for each of its documents; the arrays only where partners are possible."""

    def run(rows: pa.Table) -> pa.Table:
        meta = next(i for i in rows["ids"].to_pylist() if i is not None)
        ids, known, n, sum1, sum2 = np.frombuffer(meta, np.int64).reshape(5, -1)
        cols = [rows[c].to_pylist() for c in ("hashes", "places", "counts")]
        m, chunk = len(n), rows["chunk"][0].as_py()
        h, text, df = (np.concatenate([np.empty(0, t), *(np.frombuffer(x, t) for x in c if x is not None)]) for c, t in zip(cols, (np.uint64, np.uint16, np.uint32), strict=True))
        rank = np.frexp(df.astype(float))[1]
        by = np.lexsort((h, rank, text))
        h, text, df, rank = h[by], text[by], df[by], rank[by]
        shared = np.bincount(text, minlength=m)
        edge = np.concatenate([[0], np.cumsum(shared)])
        fragment = (rank.astype(np.int32) - 1) // POWERS
        need = (percent * n + 99) // 100
        weight = np.bincount(text, weights=df, minlength=m) / np.maximum(n, 1)
        out = []
        for t in range(m):
            uid, doc = (chunk << 16) | t, int(ids[t]) if known[t] else None
            row = [uid, doc, int(n[t]), int(sum1[t]), int(sum2[t]), float(weight[t]), None, None, None, None, None]
            if n[t] and shared[t] >= need[t]:
                a, b = edge[t], edge[t + 1]
                alone = int(n[t] - shared[t])  # these come first in the order
                first = int(n[t] - need[t] + 1) - alone
                own = h[a:b].view(np.int64)
                row[6:] = own[:first], np.arange(alone, alone + first, dtype=np.int32), alone, own, fragment[a:b]
            out.append(row)
        types = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _SET.split(", ")])

    return run


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b, na, nb) the (a, b) that are similar: a partial overlap for each pair and fragment, summed per pair."""
    left = segments.select(F.col("uid").alias("a"), "fragment", F.col("segment").alias("left"))
    right = segments.select(F.col("uid").alias("b"), "fragment", F.col("segment").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).cast("long").alias("partial"))
    counted = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    return counted.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id, n_links.

    docs needs doc_id and text; whatever else it has is ignored. A document's set is its distinct shingles of k lower-cased
    (A-Z) words; with fewer words, all of them as one; a null, empty or blank text has an empty set, n_shingles 0, and
    links with nothing. Two rows link when 100 * intersection >= percent * union of their sets. class_id and component_id
    are the smallest doc_id of the rows with the same set, and of those reachable by links; a null doc_id yields to any
    other, and a row that reaches only null ones has null. Repeated rows are rows of their own and link with each other.
    n_links counts the tested links between different sets that hold the row's component together, its own class's only.
    An empty table gives an empty result. docs must give the same rows in the same order when it is read again after a
    lost executor, as files do.
    """
    spark = docs.sparkSession
    parts = fragments(docs)
    runs = texts(docs).mapInArrow(_runs(k, parts), _RUN)
    counted = runs.groupBy("part").applyInArrow(_frequencies, _RUN)
    sets = materialize(counted.groupBy("chunk").applyInArrow(_prefixes(percent), _SET))

    able = sets.where("shared is not null")
    classes = able.groupBy("n", "sum1", "sum2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("class_id"))
    classes = materialize(classes)
    reps = able.join(classes.select(F.col("rep").alias("uid")), "uid")
    reps = materialize(reps.select("uid", "n", "weight", "prefix", "prefix_at", "shared", "cut"))
    segments = reps.select("uid", F.explode(F.arrays_zip("cut", "shared")).alias("x")).groupBy("uid", F.col("x.cut").alias("fragment")).agg(F.collect_list("x.shared").alias("segment"))
    segments = materialize(segments)

    posted = reps.select("uid", "n", "weight", F.explode(F.arrays_zip("prefix", "prefix_at")).alias("x")).select("uid", "n", "weight", F.col("x.prefix").alias("key"), F.col("x.prefix_at").alias("at"))
    heaviest = F.struct("weight", -F.col("uid"))
    held = posted.groupBy("key").agg(F.count("*").alias("holders"), F.max_by(F.struct("uid", "n", "at"), heaviest).alias("lead")).where("holders > 1").drop("holders")
    # written first, so that the join of a key that many documents hold can be split
    state = materialize(posted.join(materialize(held), "key"))

    def possible(n1, at1, n2, at2):
        """Whether sets of these sizes can be similar if what stands before these places in their orders is not common to them."""
        most = F.least(n1 - at1, n2 - at2)
        return 100 * most >= percent * (n1 + n2 - most)

    with_lead = possible(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")) & (F.col("uid") != F.col("lead.uid"))
    ends = F.least("uid", "lead.uid").alias("a"), F.greatest("uid", "lead.uid").alias("b"), F.when(F.col("uid") < F.col("lead.uid"), F.col("n")).otherwise(F.col("lead.n")).alias("na"), F.when(F.col("uid") < F.col("lead.uid"), F.col("lead.n")).otherwise(F.col("n")).alias("nb")
    links = materialize(_verified(state.where(with_lead).select(*ends).distinct(), segments, percent))
    for last in (False, True):
        found = materialize(components(links)).toDF("uid", "component")
        state = state.drop("lead", "component").join(found, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        mixed = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", heaviest).alias("main")).where("low < high").select("key", "main")
        state = materialize(state.join(materialize(mixed), "key"))
        if state.isEmpty():
            break
        if last:
            # each against each of another component of its group, where the places in the order allow it
            one, two = (state.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("uid", "n", "at", "component"))) for i in "12")
            near = (F.col("uid1") < F.col("uid2")) & (F.col("component1") != F.col("component2")) & possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"))
            rest = one.join(two, "key").where(near).select(F.col("uid1").alias("a"), F.col("uid2").alias("b"), F.col("n1").alias("na"), F.col("n2").alias("nb"))
        else:
            # a second leader: the heaviest outside of the heaviest's component
            second = state.where("component <> main").groupBy("key").agg(F.max_by(F.struct("uid", "n", "at", "component"), heaviest).alias("lead"))
            rest = state.join(materialize(second), "key").where(F.col("component") != F.col("lead.component")).where(with_lead).select(*ends)
            state = state.drop("main")
        more = _verified(rest.distinct(), segments, percent)
        links = materialize(links.union(more).distinct())
    found = materialize(components(links)).toDF("uid", "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = classes.join(found.toDF("rep", "component"), "rep", "left").join(degree, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = classes.join(least, "component").select("n", "sum1", "sum2", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rest = sets.where("shared is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rest.union(able.join(known, ["n", "sum1", "sum2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", "n_links"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

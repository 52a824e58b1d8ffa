"""Operator 1: learned quality rules, all in DataFrame expressions.

A decision list is learned by sequential covering from labelled statistics. Rules are conjunctions of thresholds that
reject. A rule is grown on two thirds of the labelled rows, condition by condition, each the one with the largest gain of
information over the rows the rule still covers; then pruned on the last third, from its last condition back, to the
prefix with the best (p - n) / (p + n). It is kept if it is precise there, the rows it covers are set aside, and the next
one is grown; what a rule covers that is not precise is set aside for growing only. The list becomes one ordered conditional expression.

The labelled rows are a sample of a bounded number; their statistics are binned in Spark by the quantiles of each, and all
that reaches the driver is a histogram of bins by class for each condition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

_GAP = r"[\x20\x09-\x0D]+"
#: Labelled rows that a list is learned from at most: those with the smallest hash of their doc_id.
LABELLED_ROWS = 20_000
#: Thresholds tried for each statistic; conditions of a rule; rules of a list; labelled rows that a rule covers at least.
BINS, CONDITIONS, RULES, SUPPORT = 64, 4, 12, 10
#: Rules grown at most, those that are not precise enough to keep included.
TRIES = 16
#: Share of low quality among the held-out rows that a rule covers, at least.
PRECISION = 0.95
#: What the rules may test, by name: expressions over the counts of statistics().
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "same_as_next": "n_same_next / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_marks", "n_capitals", "n_digits", "n_same_next", "n_distinct", "n_lines"]


def _among(text: Column, kind: str) -> Column:
    """How many characters of the class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Two structs: `row`, docs' columns, and `counts`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _MORE.

    Each text is taken whole, in its row. A window's words are hashed to 64 bits; windows of a text with equal hashes
    count as equal. A text without repeated windows, which is known by the number of distinct hashes, is not sorted.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held = F.struct(*(docs[c] for c in docs.columns))
    split = docs.select(held.alias("row"), text.alias("text"), F.filter(F.split(text, _GAP), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))
    hashed = split.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, window))))
    ordered = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = hashed.withColumn("ordered", ordered)
    m = F.size("ordered")

    def twin(x: Column, i: Column) -> Column:
        h = F.col("ordered")[F.least(i + 1, m - 1)]["h"], F.col("ordered")[F.greatest(i - 1, F.lit(0))]["h"]
        return ((i < m - 1) & (h[0] == x["h"])) | ((i > 0) & (h[1] == x["h"]))

    again = sorted_.withColumn("at", F.array_sort(F.transform(F.filter("ordered", twin), lambda x: x["i"])))
    # each repeated window covers the words up to the next one, or all of its own
    covered = F.aggregate(F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda s, x: s + x)
    joined = F.array_join("words", "")
    counts = {
        "n_words": n,
        "word_chars": F.length(joined),
        "n_symbols": _among(F.col("text"), "#*$%&|<>"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_marks": _among(F.col("text"), "!?"),
        "n_capitals": _among(F.col("text"), r"\p{Lu}"),
        "n_digits": _among(F.col("text"), "0-9"),
        "n_same_next": F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_lines": F.size("lines"),
    }
    return again.select("row", F.struct(*(c.cast("long").alias(k) for k, c in counts.items())).alias("counts"))


def _features() -> Column:
    """The features of a row with the counts as columns."""
    return F.struct(*(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))


Rule = list[tuple[str, str, float]]


def _condition(rule: Rule) -> Column:
    """The conjunction of a rule, over the struct column `features`."""
    out = F.lit(True)
    for name, sign, value in rule:
        out = out & (F.col("features")[name] >= value if sign == ">=" else F.col("features")[name] < value)
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, precision: float = PRECISION) -> list[Rule]:
    """A decision list that rejects low quality (labels.quality 0), from at most `rows` labelled documents.

    docs needs doc_id and text, labels doc_id and quality; whatever else they have is ignored. Rows with null in these are
    not learned from; of several labels of a document the largest counts, and of repeated documents each. The list is
    empty where either class is missing. Ties go to the statistic that FEATURES has first, >= before <, the smaller
    threshold.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    # at most `rows` ids and labels, some hundred KB
    sample = statistics(own.join(F.broadcast(known), "doc_id")).select((F.col("row.quality") == 0).alias("low"), (F.pmod(F.xxhash64("row.doc_id", F.lit(1)), F.lit(3)) == 0).alias("held"), "counts.*")
    sample = materialize(sample.select("low", "held", _features().alias("features")))
    cuts = sample.agg(*(F.percentile_approx(F.col("features")[k], [i / BINS for i in range(1, BINS)], 10_000).alias(k) for k in FEATURES)).first()
    if cuts is None or any(cuts[k] is None for k in FEATURES):
        return []
    # a value's bin is the number of thresholds that it reaches; just above the smallest value is a threshold too
    bounds = {k: sorted(set(cuts[k]) | {math.nextafter(x, math.inf) for x in cuts[k]}) for k in FEATURES}

    def reached(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds[name])), lambda t: F.col("features")[name] >= t))

    sample = materialize(sample.withColumn("bins", F.array(*map(reached, FEATURES))))

    def histogram(where: Column) -> dict[int, dict[int, list[int]]]:
        got = sample.where(where).select("low", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()
        out: dict[int, dict[int, list[int]]] = {}
        for r in got:
            out.setdefault(r.f, {})[r.bin] = [r.p, r.n]
        return out

    def covered(rule: Rule, where: Column) -> tuple[int, int]:
        r = sample.where(where & _condition(rule)).agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).first()
        return r.p, r.n

    grow, test, rules = ~F.col("held"), F.col("held"), []
    for _ in range(TRIES):
        if len(rules) == RULES:
            break
        rule: Rule = []
        while len(rule) < CONDITIONS:
            bars = histogram(grow & _condition(rule))
            if not bars:
                break
            p0, n0 = (sum(x[i] for x in bars[0].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, gained = None, 0.0
            for f, name in enumerate(FEATURES):
                p = n = 0
                for t in range(len(bounds[name]), 0, -1):
                    p, n = p + bars[f].get(t, [0, 0])[0], n + bars[f].get(t, [0, 0])[1]
                    for sign, a, b in ((">=", p, n), ("<", p0 - p, n0 - n)):
                        if a >= SUPPORT:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            if gain > gained * (1 + 1e-12):
                                best, gained = (name, sign, float(bounds[name][t - 1])), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        # the prefix that does best on the rows held out
        scored = [(k, *covered(rule[:k], test)) for k in range(1, len(rule) + 1)]
        scored = [((p - n) / (p + n), p, -k) for k, p, n in scored if p + n > 0]
        worth, p, k = max(scored, default=(-1.0, 0, -len(rule)))
        if (worth + 1) / 2 < precision or p < SUPPORT / 2:
            # what it covers is set aside for growing alone, and others are tried
            grow = grow & ~_condition(rule)
            continue
        rule = rule[:-k]
        rules.append(rule)
        grow, test = grow & ~_condition(rule), test & ~_condition(rule)
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the number of the first rule that rejects, from 1, else 0."""
    if not rules:
        return F.lit(0)
    out = F.when(_condition(rules[0]), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(_condition(rule), i)
    return out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], min_words: int = 20, repeat_percent: int = 30, name: str = "verdict") -> DataFrame:
    """docs with a struct column `name`: the base counts, base_failed, rule and kept.

    base_failed: fewer than min_words words, or over repeat_percent of 100 words in repeated windows. rule: the number of
    the first rule that rejects, or 0. kept: neither. docs needs text; all other columns pass through, whatever their names,
    but one called `name` is replaced. A null text has no words and fails. Repeated rows are judged alike.
    """
    base = (F.col("counts.n_words") < min_words) | (100 * F.col("counts.n_repeat_words") > repeat_percent * F.col("counts.n_words"))
    features = F.struct(*(F.expr(_qualified(e)).cast("double").alias(k) for k, e in FEATURES.items()))
    ruled = statistics(docs).withColumn("features", features).withColumn("rule", expression(rules).cast("int"))
    # always true, and not deterministic: a filter on the verdict stays above it, else its copy of the expressions would be nested many times over
    here = F.monotonically_increasing_id() >= 0
    verdict = F.struct(*(F.col(f"counts.{c}").alias(c) for c in _COUNTS), base.alias("base_failed"), F.col("rule"), (~base & (F.col("rule") == 0) & here).alias("kept"))
    return ruled.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != name), verdict.alias(name))


def _qualified(e: str) -> str:
    for c in _COUNTS + _MORE:
        e = e.replace(f"({c}", f"(counts.{c}").replace(f"{c} /", f"counts.{c} /")
    return e


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "verdict.*")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1: the counts and the base rule, over the whole table."""
    return judge(documents(spark, sf_dir).select("doc_id", "text"), []).select("doc_id", "verdict.*").drop("rule", "kept")


COUNTS_ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM t) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
"""

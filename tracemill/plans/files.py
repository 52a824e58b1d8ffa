"""Queries through trace files: the tables become a trace, are written as a file, and read back by the data source."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import trace as T
from ..sources.scratch import shared_dir
from ..sources.waveform import read_trace, write_trace
from . import tables as t
from .queries import _case, _code, _names, query

_WRITTEN: dict[tuple[str, str], str] = {}
_HIER = "ord long, kind string, type_code int, subtype_code int, name string, component string, direction_code int, length int, handle int, is_alias boolean, arg long, arg_from_name long, depth int, path string"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as scopes, with customers as variables and suppliers as aliases of the variable before; a note and its end in each region."""
    n, r = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    places = F.broadcast(n.join(r, F.expr("n_regionkey = r_regionkey")))  # tens of rows
    null = lambda kind: F.lit(None).cast(kind)

    def rows(df, kind, key, name=None, path=None, depth=0, type_code=None, alias=None, attr=False):
        at = F.struct(*(F.lit(k).cast("long") if isinstance(k, int) else F.col(k).cast("long") for k in key))
        return df.select(
            at.alias("at"), F.lit(kind).alias("kind"), (F.expr(type_code) if type_code else null("int")).cast("int").alias("type_code"), (F.lit(2) if attr else null("int")).alias("subtype_code"),
            (F.expr(name) if name else null("string")).alias("name"), (F.lit("") if kind == "scope" else null("string")).alias("component"), (F.lit(1) if kind == "var" else null("int")).alias("direction_code"),
            (F.lit(16) if kind == "var" else null("int")).alias("length"), F.lit(alias).cast("boolean").alias("is_alias"), (F.lit(7) if attr else null("int")).cast("long").alias("arg"), null("long").alias("arg_from_name"),
            F.lit(depth).alias("depth"), (F.expr(path) if path else F.lit("")).alias("path"),
        )

    out = rows(r, "scope", ("r_regionkey", -2, 0, 0), "r_name", "r_name", 0, "0")
    out = out.union(rows(r, "attr", ("r_regionkey", -1, 0, 0), "concat('note of ', r_name)", "r_name", 1, "0", attr=True)).union(rows(r, "attr_end", ("r_regionkey", -1, 1, 0), path="r_name", depth=1))
    out = out.union(rows(places, "scope", ("r_regionkey", "n_nationkey", 0, 0), "n_name", "concat(r_name, '.', n_name)", 1, "n_nationkey % 22"))
    for name, p, alias, rank in (("customer", "c_cust", False, 1), ("supplier", "s_supp", True, 2)):
        own = t.table(spark, sf_dir, name).join(places, F.expr(f"{p[0]}_nationkey = n_nationkey"))
        out = out.union(rows(own, "var", ("r_regionkey", "n_nationkey", rank, f"{p}key"), f"{p[0]}_name", f"concat(r_name, '.', n_name, '.', {p[0]}_name)", 2, "16", alias))
    out = out.union(rows(places, "upscope", ("r_regionkey", "n_nationkey", 3, 0), path="concat(r_name, '.', n_name)", depth=2)).union(rows(r, "upscope", ("r_regionkey", 1000, 0, 0), path="r_name", depth=1))
    numbered = out.withColumn("ord", (F.row_number().over(T.Window.orderBy("at")) - 1).cast("long"))
    upto = T.Window.orderBy("ord").rowsBetween(T.Window.unboundedPreceding, 0)
    handle = F.sum(F.when((F.col("kind") == "var") & ~F.col("is_alias"), 1).otherwise(0)).over(upto).cast("int")
    return numbered.withColumn("handle", F.when(F.col("kind") == "var", handle)).select([x.split()[0] for x in _HIER.split(", ")])


def _trace(spark: SparkSession, sf_dir: str) -> T.Trace:
    signals = F.broadcast(t.table(spark, sf_dir, "customer").agg(F.count("*").alias("signals"), F.lit(1).alias("one")))  # one row
    c = t.changes(spark, sf_dir).withColumn("one", F.lit(1)).join(signals, "one")
    c = c.select("time", ((F.col("handle") - 1) % F.col("signals") + 1).cast("int").alias("handle"), "seq", "value")
    hier = _records(spark, sf_dir)
    meta = c.agg(F.min("time").alias("start_time"), F.max("time").alias("end_time")).select("*", F.lit("a day").alias("date"), F.lit("tracemill").alias("version"), F.lit(0).alias("file_type"), F.lit(-6).alias("timescale_exp"), F.lit(-3).cast("long").alias("timezero"))
    for name in ("num_scopes", "num_vars", "num_aliases", "max_handle"):
        meta = meta.withColumn(name, F.lit(0).cast("long"))
    return T.Trace(T.recounted(meta, hier), hier, c, t.blackouts(spark, sf_dir))


def _file(spark: SparkSession, sf_dir: str) -> str:
    """The file of these tables, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        path = f"{shared_dir(spark).removeprefix('file:')}/{os.urandom(8).hex()}.trace"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        write_trace(_trace(spark, sf_dir), path, block_changes=2500)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _read(spark: SparkSession, sf_dir: str, **options: str) -> T.Trace:
    return read_trace(spark, _file(spark, sf_dir), **options)


def _bounds(trace: T.Trace) -> tuple[int, int]:
    a, b = trace.bounds()
    return a + (b - a) // 4, a + (b - a) // 2


_SQL = (
    t.with_("changes", "blackouts")
    + ", p AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), "
    + "h0 AS (SELECT r_regionkey AS a, -2::BIGINT AS b, 0 AS c, 0::BIGINT AS d, 'scope' AS kind, 0 AS type_code, r_name AS name, false AS is_alias, 0 AS depth, r_name AS path FROM region"
    + " UNION ALL SELECT r_regionkey, -1, 0, 0, 'attr', 0, 'note of ' || r_name, false, 1, r_name FROM region UNION ALL SELECT r_regionkey, -1, 1, 0, 'attr_end', NULL, NULL, false, 1, r_name FROM region"
    + " UNION ALL SELECT r_regionkey, n_nationkey, 0, 0, 'scope', (n_nationkey % 22)::INT, n_name, false, 1, r_name || '.' || n_name FROM p"
    + " UNION ALL SELECT r_regionkey, n_nationkey, 1, c_custkey, 'var', 16, c_name, false, 2, r_name || '.' || n_name || '.' || c_name FROM p JOIN customer ON c_nationkey = n_nationkey"
    + " UNION ALL SELECT r_regionkey, n_nationkey, 2, s_suppkey, 'var', 16, s_name, true, 2, r_name || '.' || n_name || '.' || s_name FROM p JOIN supplier ON s_nationkey = n_nationkey"
    + " UNION ALL SELECT r_regionkey, n_nationkey, 3, 0, 'upscope', NULL, NULL, false, 2, r_name || '.' || n_name FROM p UNION ALL SELECT r_regionkey, 1000, 0, 0, 'upscope', NULL, NULL, false, 1, r_name FROM region), "
    + "h AS (SELECT *, row_number() OVER w - 1 AS ord, CASE WHEN kind = 'var' THEN sum(CASE WHEN kind = 'var' AND NOT is_alias THEN 1 ELSE 0 END) OVER w END::INT AS handle FROM h0 WINDOW w AS (ORDER BY a, b, c, d)), "
    + "v AS (SELECT * FROM h WHERE kind = 'var'), vars AS (SELECT * FROM v), "
    + "e AS (SELECT time, ((handle - 1) % (SELECT count(*) FROM customer) + 1)::INT AS handle, seq, value FROM changes), "
    + "r AS (SELECT a, b, a + (b - a) // 4 AS lo, a + (b - a) // 2 AS hi FROM (SELECT min(time) AS a, max(time) AS b FROM e)) "
)

query("file_changes", _SQL + "SELECT time, handle, value, false AS is_initial FROM e")(lambda s, d: _read(s, d).changes.select("time", "handle", "value", "is_initial"))
query("file_hierarchy", _SQL + "SELECT ord, kind, coalesce(type_code, -1) AS type_code, name, coalesce(handle, -1) AS handle, is_alias, CASE WHEN kind = 'var' THEN 16 ELSE -1 END AS length, depth, path FROM h")(
    lambda s, d: _read(s, d).hier.select("ord", "kind", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("type_code", "handle", "length")), F.coalesce("is_alias", F.lit(False)).alias("is_alias"), "name", "depth", "path")
)
query(
    "file_metadata",
    _SQL + "SELECT 'a day' AS date, 'tracemill' AS version, 'Verilog' AS file_type, '1us' AS timescale, -3::BIGINT AS timezero, a AS start_time, b AS end_time, (SELECT count(*) FROM h WHERE kind = 'scope') AS num_scopes, (SELECT count(*) FROM v) AS num_vars, (SELECT count(*) FROM v WHERE is_alias) AS num_aliases FROM r",
)(lambda s, d: T.metadata(_read(s, d).metadata))
query("file_blackouts", _SQL + "SELECT * FROM blackouts")(lambda s, d: _read(s, d).blackouts)
query("file_attributes", _SQL + "SELECT name, 7::BIGINT AS arg FROM h WHERE kind = 'attr'")(lambda s, d: T.attributes(_read(s, d).hier.where("kind = 'attr'")).select("name", "arg"))
query("file_signals", _SQL + "SELECT time, handle, value FROM e WHERE handle IN (SELECT handle FROM v WHERE regexp_matches(path, 'ASIA|7$'))")(lambda s, d: _read(s, d, signals="ASIA|7$").changes.select("time", "handle", "value"))


@query("file_time_limit", _SQL + "SELECT time, handle, value FROM e, r WHERE time BETWEEN lo AND hi")
def file_time_limit(s, d):
    lo, hi = _bounds(_read(s, d))
    return _read(s, d, start=str(lo), end=str(hi)).changes.where(F.col("time").between(lo, hi) & ~F.col("is_initial")).select("time", "handle", "value")


@query("file_value_at", _SQL + "SELECT handle, arg_max(value, (time, seq)) AS value FROM e, r WHERE time <= hi GROUP BY handle")
def file_value_at(s, d):
    """Only the block that holds the time, and its frame, are read."""
    hi = _bounds(_read(s, d))[1]
    # before its first change a signal has the writer's initial value
    return T.value_at(_read(s, d, start=str(hi), end=str(hi)).changes, hi).where("value not like '%x%'")


@query("file_find", _SQL + ", " + _names("regexp_matches(path, 'Customer')") + "SELECT time, handle, name, value FROM (SELECT handle, min(time) AS time, arg_min(value, (time, seq)) AS value FROM e WHERE regexp_matches(value, '01$') GROUP BY handle) JOIN names USING (handle)")
def file_find(s, d):
    return _read(s, d).find("01$", regex=True, signals="Customer").select("time", "handle", "name", "value")


_KEPT = (
    ", k AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY ord) > 1 AS again FROM v WHERE regexp_matches(name, '[05]$')), m AS (SELECT handle, row_number() OVER (ORDER BY min(ord))::INT AS new_handle FROM k GROUP BY handle) "
)


def _clipped(s: SparkSession, d: str) -> T.Trace:
    """A clip that is written and read again."""
    key = s.sparkContext.applicationId, f"clip of {d}"
    if key not in _WRITTEN:
        path = f"{_file(s, d)}.clip"
        read = _read(s, d)
        # a task reads the records of a file, and a clip asks for them many times
        read.hier.write.mode("overwrite").parquet(f"file:{path}.records")
        trace = T.Trace(read.metadata, s.read.schema(read.hier.schema).parquet(f"file:{path}.records"), read.changes, read.blackouts)
        write_trace(trace.clip(*_bounds(trace), "[05]$"), path, block_changes=2500)
        _WRITTEN[key] = path
    return read_trace(s, _WRITTEN[key])


query("file_clip_vars", _SQL + _KEPT + "SELECT path, new_handle AS handle, again AS is_alias FROM k JOIN m USING (handle)")(lambda s, d: _clipped(s, d).vars.select("path", "handle", "is_alias"))
query("file_clip_scopes", _SQL + _KEPT + "SELECT kind, path FROM h WHERE kind IN ('scope', 'upscope') AND EXISTS (SELECT 1 FROM k WHERE starts_with(k.path, h.path || '.')) UNION ALL SELECT 'counts', count(*) || ' ' || count(*) FILTER (again) FROM k")(
    lambda s, d: _clipped(s, d).hier.where("kind in ('scope', 'upscope')").select("kind", "path").union(_clipped(s, d).metadata.select(F.lit("counts"), F.concat_ws(" ", "num_vars", "num_aliases")))
)
query(
    "file_clip_changes",
    _SQL + _KEPT + ", x AS (SELECT 0::BIGINT AS time, handle, arg_max(value, (time, seq)) AS value FROM e, r WHERE time <= lo GROUP BY handle UNION ALL SELECT time - lo, handle, value FROM e, r WHERE time > lo AND time <= hi) SELECT time, new_handle AS handle, value FROM x JOIN m USING (handle)",
)(lambda s, d: _clipped(s, d).changes.select("time", "handle", "value"))

_scope = f"'$scope ' || {_case('type_code', labels.VCD_SCOPE_TYPES).replace('Unknown', 'module')} || ' ' || name || ' $end'"


@query(
    "file_vcd",
    _SQL
    + "SELECT 'head' AS part, unnest(['$date a day $end', '$version tracemill $end', '$timezero -3 $end', '$timescale 1us $end', '$enddefinitions $end']) AS line"
    + f" UNION ALL SELECT 'head', CASE kind WHEN 'scope' THEN {_scope} WHEN 'upscope' THEN '$upscope $end' ELSE '$var wire 16 ' || {_code('handle')} || ' ' || name || ' $end' END FROM h WHERE kind IN ('scope', 'upscope', 'var')"
    + f" UNION ALL SELECT 'body', line FROM (SELECT DISTINCT '#' || time AS line FROM e) UNION ALL SELECT 'body', 'b' || value || ' ' || {_code('handle')} FROM e"
    + " UNION ALL SELECT 'body', '$dump' || CASE WHEN active THEN 'on' ELSE 'off' END || ' $end' FROM blackouts WHERE time IN (SELECT time FROM e)",
)
def file_vcd(s, d):
    trace = _read(s, d)
    head = T.header_lines(trace.metadata, trace.hier).select(F.lit("head").alias("part"), "line")
    return head.union(T.value_lines(trace.changes, trace.blackouts).select(F.lit("body"), "line"))

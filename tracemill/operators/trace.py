"""Operators over a trace: catalogue, search, point lookups, clipping, export.

A trace is four DataFrames: metadata (one row), hier (records in order), changes (time, handle, seq, value, ...) and
blackouts (idx, time, active). The fact table changes is only ever filtered, joined with the small catalogue by handle and
aggregated by handle; nothing but the export sorts it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, labels, text

#: A side that the planner knows to have at most so many bytes, or that has so few rows, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 8_000_000, 200_000
#: Up to so many handles a selection is a list in the filter, which reaches the scan.
LISTED_HANDLES = 1000


class TraceError(ValueError):
    """A request that the trace cannot answer."""


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small: by the planner's bound, which costs nothing, or else by counting so many rows at most."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if known <= BROADCAST_BYTES or df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# catalogue


def variables(vars_: DataFrame, aliases: bool = True) -> DataFrame:
    """handle, type, direction, name (path), length, alias_of: the canonical path of the handle, for aliases."""
    listed = vars_.select("handle", labels.label(F.col("type_code"), labels.VAR_TYPES).alias("type"), labels.label(F.col("direction_code"), labels.DIRECTIONS).alias("direction"), F.col("path").alias("name"), "length", "is_alias")
    if not aliases:
        return listed.where(~F.col("is_alias")).drop("is_alias")
    canonical = vars_.where(~F.col("is_alias")).select("handle", F.col("path").alias("alias_of"))
    return listed.join(canonical, "handle", "left").withColumn("alias_of", F.when(F.col("is_alias"), F.col("alias_of"))).drop("is_alias")


def scopes(hier: DataFrame) -> DataFrame:
    return hier.select(labels.label(F.col("type_code"), labels.SCOPE_TYPES).alias("type"), "name", "component")


def attributes(attrs: DataFrame) -> DataFrame:
    """type, subtype, name, arg, arg_from_name; the last for source stems (Misc 4 and 5) only."""
    stem = (F.col("type_code") == 0) & F.col("subtype_code").isin(4, 5)
    return attrs.select(labels.label(F.col("type_code"), labels.ATTR_TYPES).alias("type"), labels.subtype_label(F.col("type_code"), F.col("subtype_code")).alias("subtype"), "name", "arg", F.when(stem, F.col("arg_from_name")).alias("arg_from_name"))


def metadata(meta: DataFrame) -> DataFrame:
    return meta.select(
        text.trimmed(F.col("date")).alias("date"), text.trimmed(F.col("version")).alias("version"), labels.label(F.col("file_type"), labels.FILE_TYPES).alias("file_type"),
        labels.timescale_text(F.col("timescale_exp")).alias("timescale"), "timezero", "start_time", "end_time", "num_scopes", "num_vars", "num_aliases",
    )


def preferred_names(vars_: DataFrame, pattern: str | None = None) -> DataFrame:
    """handle, name: of the paths that match, the canonical one, else the first alias."""
    found = vars_ if pattern is None else vars_.where(F.col("path").rlike(bits.checked_pattern(pattern)))
    return found.groupBy("handle").agg(F.min_by("path", F.struct("is_alias", "ord")).alias("name"))


def assign_handles(vars_: DataFrame) -> DataFrame:
    """A running count of the variables that are no alias, in the order of ord. The catalogue is small: one task counts."""
    return vars_.withColumn("handle", F.sum((~F.col("is_alias")).cast("int")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def selected(changes: DataFrame, handles: DataFrame, keep: bool = True) -> DataFrame:
    """The changes of (or not of) the handles; a short list becomes a filter that reaches the scan. A null handle is none of them."""
    handles = handles.select("handle").where("handle is not null").distinct()
    got = [r.handle for r in handles.limit(LISTED_HANDLES + 1).collect()]
    if len(got) <= LISTED_HANDLES:
        return changes.where(F.col("handle").isin(got) if keep else F.coalesce(~F.col("handle").isin(got), F.lit(True)))
    return changes.join(handles, "handle", "left_semi" if keep else "left_anti")


# search


def predicate(value: Column, wanted: str, hexadecimal: bool = False, regex: bool = False) -> Column:
    """The test for a value: exact bits or hexadecimal digits, or a regular expression on either view."""
    if regex:
        return (bits.to_hex(value) if hexadecimal else value).rlike(bits.checked_pattern(wanted))
    return bits.equals_bits(value, bits.bits_of_literal(wanted, hexadecimal))


def find(changes: DataFrame, vars_: DataFrame, wanted: str, hexadecimal: bool = False, regex: bool = False, all_matches: bool = False, signals: str | None = None) -> DataFrame:
    """time, handle, name, value of the changes that match: the first of each handle, or all. Changes come with their preferred name."""
    return named(changes.where(predicate(F.col("value"), wanted, hexadecimal, regex)), vars_, all_matches, signals)


def named(hits: DataFrame, vars_: DataFrame, all_matches: bool = False, signals: str | None = None) -> DataFrame:
    """The first hit of each handle, or all, with the handle's preferred name; of the signals whose path matches, if asked for."""
    names = preferred_names(vars_, signals)
    if not all_matches:
        # folded before the names are joined: a row a handle moves
        hits = hits.groupBy("handle").agg(F.min_by(F.struct("time", "seq", "value"), F.struct("time", "seq")).alias("x")).select("handle", "x.*")
    return hits.join(names, "handle").select("time", "handle", "seq", "name", "value")


def hit_lines(hits: DataFrame, names_only: bool = False) -> DataFrame:
    if names_only:
        return hits.select("name")
    return hits.select(F.format_string("#%d %s %s", "time", "name", "value").alias("line"))


# points in time


def value_at(changes: DataFrame, time: int) -> DataFrame:
    """handle, value: the last change at or before the time."""
    return changes.where(F.col("time") <= time).groupBy("handle").agg(F.max_by("value", F.struct("time", "seq")).alias("value"))


def values_at(changes: DataFrame, points: DataFrame, bucket: int | None = None) -> DataFrame:
    """points (handle, at) with the value at that time, or null: both sides in one order per handle, the last value carried on.

    With a bucket, times are dealt into buckets of so many units, each on its own, so that a signal that changes all the
    time is many tasks' work; what a bucket begins with comes from a row for each handle and bucket.
    """
    cut = lambda time: F.floor(F.col(time) / bucket) if bucket else F.lit(0).cast("long")
    dealt = changes.select("handle", F.col("time").alias("at"), "seq", "value", F.lit(1).alias("side"), cut("time").alias("bucket"))
    asked = points.select("handle", "at", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("value"), F.lit(2).alias("side"), cut("at").alias("bucket"))
    both = dealt.unionByName(asked)
    if bucket:
        last = dealt.groupBy("handle", "bucket").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))
        last = last.unionByName(asked.select("handle", "bucket").distinct().withColumn("value", F.lit(None).cast("string")))
        ends = last.groupBy("handle", "bucket").agg(F.max("value").alias("value"))
        upto = Window.partitionBy("handle").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.withColumn("value", F.last("value", ignorenulls=True).over(upto)).where("value is not null")
        both = both.unionByName(begins.select("handle", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("seq"), "value", F.lit(0).alias("side"), "bucket"))
    order = Window.partitionBy("handle", "bucket").orderBy(F.col("at").asc_nulls_first(), "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(order)).where("side = 2").select("handle", "at", "value")


def frames(changes: DataFrame, block: Column) -> DataFrame:
    """block, handle, value: the value of each handle at the end of each block of which there are changes, carried on from earlier blocks.

    Changes fold to a row for each block and handle before they move; a value holds up to the next block in which its
    handle changes. Blocks are numbered in order, and as many rows as blocks are broadcast if that is few.
    """
    last = changes.withColumn("block", block).groupBy("block", "handle").agg(F.max_by("value", F.struct("time", "seq")).alias("value"))
    blocks = last.select("block").distinct().withColumn("number", F.row_number().over(Window.orderBy("block")))
    known = blocks.agg(F.count("*").cast("int").alias("blocks"), F.lit(1).alias("one"))
    held = last.join(blocks, "block").withColumn("next", F.lead("number").over(Window.partitionBy("handle").orderBy("number")))
    held = held.withColumn("one", F.lit(1)).join(F.broadcast(known), "one")  # one row
    held = held.select("handle", "value", F.explode(F.sequence("number", F.coalesce(F.col("next") - 1, F.col("blocks")))).alias("number"))
    return held.join(blocks, "number").select("block", "handle", "value")


def blackout_intervals(blackouts: DataFrame) -> DataFrame:
    """off_from, off_to: [from, to) of each time of no recording; open ends are null. Toggles are few."""
    ordered = blackouts.withColumn("off_to", F.lead("time").over(Window.orderBy("idx")))
    return ordered.where("active = false").select(F.col("time").alias("off_from"), "off_to")


# clipping


def check_range(start: int | None, end: int | None, first: int, last: int) -> tuple[int, int]:
    start, end = first if start is None else start, last if end is None else end
    if not first <= start <= end <= last:
        raise TraceError(f"the range {start}..{end} is not in {first}..{last}")
    return start, end


def clip(changes: DataFrame, start: int, end: int) -> DataFrame:
    """The last change up to start at time 0 for each handle, and every change in (start, end] at time - start; other columns as they are.

    One pass over the changes up to end: those up to start fold to one row a handle before they move.
    """
    rest = [c for c in changes.columns if c not in ("time", "handle")]
    upto = changes.where(F.col("time") <= end)
    seed = upto.where(F.col("time") <= start).groupBy("handle").agg(F.max_by(F.struct(*rest), F.struct("time", "seq")).alias("x"))
    seed = seed.select(F.lit(0).cast("long").alias("time"), "handle", "x.*")
    return seed.unionByName(upto.where(F.col("time") > start).select((F.col("time") - start).alias("time"), "handle", *rest))


def clip_handles(vars_: DataFrame, pattern: str | None) -> DataFrame:
    """handle, new_handle: of the variables whose own name matches, numbered by the first of each handle. None is an error."""
    found = vars_ if pattern is None else vars_.where(F.col("name").rlike(bits.checked_pattern(pattern)))
    first = found.groupBy("handle").agg(F.min("ord").alias("ord"))
    if first.isEmpty():
        raise TraceError("no signal matches")
    return first.select("handle", F.row_number().over(Window.orderBy("ord")).cast("int").alias("new_handle"))


def clip_variables(vars_: DataFrame, pattern: str | None) -> DataFrame:
    """The kept variables with new handles; the first of a handle is canonical."""
    found = vars_ if pattern is None else vars_.where(F.col("name").rlike(bits.checked_pattern(pattern)))
    first = Window.partitionBy("handle").orderBy("ord")
    return found.withColumn("is_alias", F.row_number().over(first) > 1).join(clip_handles(vars_, pattern), "handle").withColumn("handle", F.col("new_handle")).drop("new_handle")


def prune_scopes(scopes_: DataFrame, kept: DataFrame) -> DataFrame:
    """The scopes (path) with a kept variable (path) somewhere inside."""
    parts = F.split(kept["path"], r"\.")
    inside = kept.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))).alias("path")).distinct()
    return scopes_.join(inside, "path", "left_semi")


def clip_hierarchy(hier: DataFrame, pattern: str | None = None, attributes: bool = True) -> DataFrame:
    """The records of a clipped trace, in order: variables whose own name matches, with new handles, and what belongs to them.

    Without a pattern all records stay. With one, a scope stays if a kept variable is inside, and opens just before the first
    of these; its end stays with it, also where a path is opened several times. Attributes and their ends stay where they
    are, or go all.
    """
    vars_ = clip_variables(hier.where("kind = 'var'"), pattern).select(hier.columns)
    others = hier.where("kind in ('attr', 'attr_end')") if attributes else hier.limit(0)
    scopes_, ends = hier.where("kind = 'scope'"), hier.where("kind = 'upscope'")
    if pattern is None:
        return vars_.unionByName(others).unionByName(scopes_).unionByName(ends)
    opened = scopes_.select(F.col("path").alias("at"), "ord", F.col("ord").alias("opened"))
    none = F.lit(None).cast("long").alias("opened")

    def innermost(rows: DataFrame) -> DataFrame:
        """rows (at, ord) with the scope of this path that was opened last before."""
        both = opened.withColumn("own", F.lit(False)).unionByName(rows.select("at", "ord", none).withColumn("own", F.lit(True)))
        upto = Window.partitionBy("at").orderBy("ord", "own").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("opened", F.last("opened", ignorenulls=True).over(upto)).where("own and opened is not null").drop("own")

    # each scope that holds kept variables itself, by its first one; then all scopes around these
    held = vars_.select(F.expr("left(path, length(path) - length(name) - 1)").alias("at"), "ord")
    held = innermost(held).groupBy("at", "opened").agg(F.min("ord").alias("ord"))
    parts = F.split("at", r"\.")
    around = held.select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("at"))
    first = innermost(around).groupBy("opened").agg(F.min("ord").alias("first"))
    kept_ends = innermost(ends.select(F.col("path").alias("at"), "ord")).join(first, "opened").select("ord")
    key = lambda place, rank: F.struct(place.alias("place"), F.lit(rank).alias("rank"), F.col("ord").alias("ord")).alias("key")
    here = [c for c in hier.columns if c != "ord"]
    rows = scopes_.join(first, scopes_["ord"] == first["opened"]).select(*here, key(F.col("first"), 0))
    for df in (vars_, others, ends.join(kept_ends, "ord", "left_semi")):
        rows = rows.unionByName(df.select(*here, key(F.col("ord"), 1)))
    return rows.withColumn("ord", (F.row_number().over(Window.orderBy("key")) - 1).cast("long")).select(hier.columns)


def recounted(meta: DataFrame, hier: DataFrame) -> DataFrame:
    """meta with the counts of these records."""
    counts = hier.agg(
        F.count_if(F.col("kind") == "scope").alias("num_scopes"), F.count_if(F.col("kind") == "var").alias("num_vars"), F.count_if((F.col("kind") == "var") & F.col("is_alias")).alias("num_aliases"),
        F.count_if((F.col("kind") == "var") & ~F.col("is_alias")).alias("max_handle"), F.lit(1).alias("one"),
    )
    own = ["num_scopes", "num_vars", "num_aliases", "max_handle"]
    return meta.drop(*own).withColumn("one", F.lit(1)).join(F.broadcast(counts), "one").select(meta.columns)  # one row each


# export


def variable_lines(vars_: DataFrame) -> DataFrame:
    """ord, line: the declarations of a VCD header."""
    kind = labels.label(F.col("type_code"), labels.VCD_VAR_TYPES)
    size = F.when(F.col("type_code").isin(labels.REAL_TYPES), F.lit(64)).otherwise(F.col("length"))
    return vars_.select("ord", F.format_string("$var %s %d %s %s $end", kind, size, text.vcd_id(F.col("handle")), F.col("name")).alias("line"))


def header_lines(meta: DataFrame, hier: DataFrame, extensions: bool = False) -> DataFrame:
    """ord, line: a VCD header. Attributes are written with extensions only; a timescale out of range is 1ns; timezero only if not 0."""
    scale = labels.timescale_text(F.col("timescale_exp"))
    scale = F.when(scale == "Unknown", "1ns").otherwise(scale)
    top = meta.select(
        F.posexplode(
            F.filter(
                F.array(
                    F.concat(F.lit("$date "), text.trimmed(F.col("date")), F.lit(" $end")), F.concat(F.lit("$version "), text.trimmed(F.col("version")), F.lit(" $end")),
                    F.when(F.col("timezero") != 0, F.concat(F.lit("$timezero "), F.col("timezero"), F.lit(" $end"))), F.concat(F.lit("$timescale "), scale, F.lit(" $end")),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("pos", "line")
    )
    top = top.select((F.col("pos") - 100).cast("long").alias("ord"), "line")
    end = meta.select(F.lit((1 << 63) - 1).alias("ord"), F.lit("$enddefinitions $end").alias("line"))
    scope = F.concat(F.lit("$scope "), labels.label(F.col("type_code"), labels.VCD_SCOPE_TYPES, "module"), F.lit(" "), F.col("name"), F.lit(" $end"))
    kinds = F.get(F.array(*map(F.lit, ["misc", "array", "enum", "class"])), F.col("type_code").cast("int"))
    attr = F.format_string("$attrbegin %s %02x %s %d $end", kinds, F.col("subtype_code"), F.col("name"), F.col("arg"))
    other = F.when(F.col("kind") == "scope", scope).when(F.col("kind") == "upscope", "$upscope $end")
    if extensions:
        other = other.when(F.col("kind") == "attr", attr).when(F.col("kind") == "attr_end", "$attrend $end")
    rest = hier.where("kind <> 'var'").select("ord", other.alias("line")).where("line is not null")
    return top.unionByName(variable_lines(hier.where("kind = 'var'"))).unionByName(rest).unionByName(end)


def value_lines(changes: DataFrame, blackouts: DataFrame | None = None) -> DataFrame:
    """time, ord, line: a mark for each time and a line for each change; sorted by (time, ord) they are a VCD body.

    Scalars are symbol and identifier, longer values b, or p with symbols beyond 01xz, value and identifier; where changes
    have real_value, var_len and raw, reals are r and texts s, escaped. Toggles at a time that has a mark follow it.
    """
    code = text.vcd_id(F.col("handle"))
    vector = F.concat(F.when(F.col("value").rlike("[^01xz]"), "p").otherwise("b"), F.col("value"), F.lit(" "), code)
    line = F.when(F.length("value") == 1, F.concat("value", code)).otherwise(vector)
    if {"real_value", "var_len", "raw"} <= set(changes.columns):
        line = F.when(F.col("var_len"), F.concat(F.lit("s"), text.escape_text(F.col("raw")), F.lit(" "), code)).when(F.col("real_value").isNotNull(), F.concat(F.lit("r"), text.real_text(F.col("real_value")), F.lit(" "), code)).otherwise(line)
    order = lambda handle, seq: F.struct(handle.cast("int").alias("handle"), seq.cast("long").alias("seq")).alias("ord")
    times = changes.select("time").distinct()
    out = times.select("time", order(F.lit(0), F.lit(0)), F.concat(F.lit("#"), F.col("time")).alias("line"))
    out = out.unionByName(changes.select("time", order(F.col("handle"), F.col("seq")), line.alias("line")))
    if blackouts is not None:
        toggles = small(blackouts).join(times, "time").select("time", order(F.lit(0), F.col("idx") + 1), F.concat(F.lit("$dump"), F.when(F.col("active"), "on").otherwise("off"), F.lit(" $end")).alias("line"))
        out = out.unionByName(toggles)
    return out


def initial_lines(vars_: DataFrame, state: DataFrame) -> DataFrame:
    """ord, line: the section $dumpvars ... $end that stands at the first time, with a line for each handle of state (handle, value); x where state has none."""
    own = vars_.where("not is_alias and type_code <> 21").select("handle", "length", F.col("type_code").isin(labels.REAL_TYPES).alias("real"))
    known = own.join(state.select("handle", "value"), "handle", "left")
    value = F.coalesce("value", F.when(F.col("real"), "nan").otherwise(F.repeat(F.lit("x"), F.col("length"))))
    code = text.vcd_id(F.col("handle"))
    vector = F.concat(F.when(F.col("real"), "r").when(value.rlike("[^01xz]"), "p").otherwise("b"), value, F.lit(" "), code)
    lines = known.select(F.col("handle").cast("long").alias("ord"), F.when((F.length(value) == 1) & ~F.col("real"), F.concat(value, code)).otherwise(vector).alias("line"))
    ends = vars_.sparkSession.createDataFrame([(0, "$dumpvars"), ((1 << 63) - 1, "$end")], "ord long, line string")
    return lines.unionByName(ends)


def source_stems(stems: DataFrame) -> DataFrame:
    """ord, path, line, path_id, first: each path numbered by its first use; the first use also declares it. A catalogue's size."""
    firsts = stems.groupBy("path").agg(F.min("ord").alias("first_ord"))
    ids = firsts.select("path", "first_ord", F.row_number().over(Window.orderBy("first_ord")).alias("path_id"))
    return stems.join(ids, "path").select("ord", "path", "line", "path_id", (F.col("ord") == F.col("first_ord")).alias("first"))


def resolve_stems(attrs: DataFrame) -> DataFrame:
    """ord, path, line of source stems (Misc 4 and 5), by the declared paths (Misc 3: name, and its number as arg)."""
    misc = attrs.where("type_code = 0").select("ord", "subtype_code", "name", "arg", "arg_from_name")
    paths = misc.where("subtype_code = 3").select(F.col("arg").alias("arg_from_name"), F.col("name").alias("path"))
    return misc.where("subtype_code in (4, 5)").join(small(paths), "arg_from_name").select("ord", "path", F.col("arg").alias("line"))


def section(row: DataFrame) -> DataFrame:
    """A one-row table as (label, value) rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


@dataclass
class Trace:
    """The four tables of a trace, with the operators as methods."""

    metadata: DataFrame
    hier: DataFrame
    changes: DataFrame
    blackouts: DataFrame

    @property
    def vars(self) -> DataFrame:
        return self.hier.where("kind = 'var'")

    def bounds(self) -> tuple[int, int]:
        r = self.metadata.select("start_time", "end_time").first()
        return r.start_time, r.end_time

    def find(self, wanted: str, **how) -> DataFrame:
        return find(self.changes, self.vars, wanted, **how)

    def value_at(self, time: int) -> DataFrame:
        return value_at(self.changes, time)

    def clip(self, start: int | None = None, end: int | None = None, signals: str | None = None, attributes: bool = True) -> Trace:
        """The trace of a time range and of the signals whose own name matches, with handles, scopes and times anew."""
        start, end = check_range(start, end, *self.bounds())
        handles = clip_handles(self.vars, signals)
        kept = clip(selected(self.changes, handles), start, end).join(small(handles), "handle").withColumn("handle", F.col("new_handle")).drop("new_handle")
        hier = clip_hierarchy(self.hier, signals, attributes)
        meta = self.metadata.withColumn("timezero", F.lit(start).cast("long")).withColumn("start_time", F.lit(0).cast("long")).withColumn("end_time", F.lit(end - start).cast("long"))
        return Trace(recounted(meta, hier), hier, kept, self.blackouts.limit(0))

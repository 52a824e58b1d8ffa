"""The queries of the trace engine over the star-schema tables, each with its SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, labels, text
from ..operators import trace as T
from . import tables as t
from .tables import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Micros of a day; one hour of the first days; a range that all scales have.
DAY = 86_400_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _first(table: str, column: str) -> str:
    return f"(SELECT min({column}) FROM {table})"


def _range(c: DataFrame) -> tuple[int, int]:
    """A range inside a trace: from a quarter to a half of it."""
    r = c.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    return r.a + (r.b - r.a) // 4, r.a + (r.b - r.a) // 2


_R = "r AS (SELECT a + (b - a) // 4 AS lo, a + (b - a) // 2 AS hi FROM (SELECT min(time) AS a, max(time) AS b FROM {0}))"
_C, _V = with_("changes"), with_("vars")
_CR = _C + ", " + _R.format("changes") + " "
_SR = with_("shipments") + ", " + _R.format("shipments") + " "
_names = lambda where="true": f"names AS (SELECT handle, arg_min(path, (is_alias::INT)::BIGINT * 10000000000 + ord) AS name FROM vars WHERE {where} GROUP BY handle) "
_case = lambda code, names: "CASE " + " ".join(f"WHEN {code} = {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'Unknown' END"
_hexsql = "(CASE WHEN len(value) = 0 THEN '' ELSE array_to_string([lower(to_hex(('0b' || substr(v4, i, 4))::INT)) FOR i IN range(1, len(v4), 4)], '') END)"
_v4 = "lpad(regexp_replace(value, '[^0]', '1', 'g'), (((len(value) + 3) // 4) * 4)::INT, '0') AS v4"


# sources

query("vc_scan", _C + "SELECT time, handle, seq, value FROM changes")(lambda s, d: t.changes(s, d).select("time", "handle", "seq", "value"))
query("vc_no_strings", _C + "SELECT time, handle, seq, value FROM changes WHERE NOT var_len")(lambda s, d: t.changes(s, d).where("not var_len").select("time", "handle", "seq", "value"))


# search


def _finder(name: str, condition: str, wanted: str, signals: str | None = None, all_matches: bool = False, **how) -> None:
    prefix = with_("changes", "vars") + ", " + _names(f"regexp_matches(path, '{signals}')" if signals else "true") + ", c AS (SELECT *, " + _v4 + " FROM changes) "
    one = "SELECT handle, arg_min(time, (time, seq)) AS time, arg_min(value, (time, seq)) AS value, arg_min(seq, (time, seq)) AS seq FROM c WHERE {} GROUP BY handle"
    hits = ("SELECT * FROM c WHERE {}" if all_matches else one).format(condition)
    query(name, prefix + f"SELECT h.time, h.handle, h.seq, n.name, h.value FROM ({hits}) h JOIN names n USING (handle)")(lambda s, d: T.find(t.changes(s, d), t.vars_(s, d), wanted, signals=signals, all_matches=all_matches, **how))


_finder("find_exact_bin", "ltrim(value, '0') = '100000000000'", "100000000000")
_finder("find_exact_hex", "ltrim(value, '0') = ltrim('0000100000000000', '0')", "0800", hexadecimal=True)
_finder("find_regex", "regexp_matches(value, '^0000.*11$')", "^0000.*11$", regex=True)
_finder("find_hex_regex", f"regexp_matches({_hexsql}, '^1.[a-f]')", "^1.[a-f]", hexadecimal=True, regex=True)
_finder("find_all", "regexp_matches(value, '0101$')", "0101$", regex=True, all_matches=True)
_finder("find_signal_regex", "regexp_matches(value, '1$')", "1$", regex=True, signals="Supplier|ASIA")
query("find_names", with_("changes", "vars") + ", " + _names() + "SELECT DISTINCT name FROM changes JOIN names USING (handle) WHERE regexp_matches(value, '^00000000')")(
    lambda s, d: T.hit_lines(T.find(t.changes(s, d), t.vars_(s, d), "^00000000", regex=True), names_only=True)
)
query("hits_text", with_("changes", "vars") + ", " + _names() + "SELECT '#' || time || ' ' || name || ' ' || value AS line FROM changes JOIN names USING (handle) WHERE regexp_matches(value, '1111$')")(
    lambda s, d: T.hit_lines(T.find(t.changes(s, d), t.vars_(s, d), "1111$", regex=True, all_matches=True))
)
query("find_preferred_name", _V + ", " + _names("regexp_matches(path, 'Supplier|EUROPE')") + "SELECT handle, name FROM names")(lambda s, d: T.preferred_names(t.vars_(s, d), "Supplier|EUROPE"))
query("mask_semi", with_("changes", "vars") + "SELECT time, handle, seq, value FROM changes WHERE handle IN (SELECT handle FROM vars WHERE is_alias)")(
    lambda s, d: T.selected(t.changes(s, d), t.vars_(s, d).where("is_alias")).select("time", "handle", "seq", "value")
)
query("mask_anti", with_("changes", "vars") + "SELECT time, handle, seq, value FROM changes WHERE handle NOT IN (SELECT handle FROM vars WHERE is_alias)")(
    lambda s, d: T.selected(t.changes(s, d), t.vars_(s, d).where("is_alias"), keep=False).select("time", "handle", "seq", "value")
)


@query("time_range", _CR + "SELECT time, handle, seq, value FROM changes, r WHERE time BETWEEN lo AND hi")
def time_range(s, d):
    c = t.changes(s, d)
    return c.where(F.col("time").between(*_range(c))).select("time", "handle", "seq", "value")


@query("value_at", _SR + "SELECT handle, arg_max(value, (time, seq)) AS value FROM shipments, r WHERE time <= lo GROUP BY handle")
def value_at(s, d):
    c = t.shipments(s, d)
    return T.value_at(c, _range(c)[0])


@query(
    "value_at_batch",
    with_("changes")
    + ", p AS (SELECT DISTINCT (o_custkey + 1)::INT AS handle, (epoch_us(o_orderdate) + (SELECT min(time) FROM changes) - (SELECT min(epoch_us(o_orderdate)) FROM orders)) AS at FROM orders WHERE o_custkey + 1 IN (SELECT handle FROM changes)) "
    "SELECT p.handle, p.at, c.value FROM p ASOF LEFT JOIN changes c ON p.handle = c.handle AND p.at >= c.time",
)
def value_at_batch(s, d):
    c, o = t.changes(s, d), t.table(s, d, "orders")
    shift = c.agg(F.min("time")).first()[0] - o.agg(F.min(t.micros("o_orderdate"))).first()[0]
    points = o.select((F.col("o_custkey") + 1).cast("int").alias("handle"), (t.micros("o_orderdate") + shift).alias("at")).distinct()
    return T.values_at(c, points.join(c.select("handle").distinct(), "handle", "left_semi"), bucket=DAY)


query("frame", with_("shipments") + f", b AS (SELECT DISTINCT time // {90 * DAY} AS block FROM shipments) SELECT block, handle, arg_max(value, (time, seq)) AS value FROM b JOIN shipments ON time // {90 * DAY} <= block GROUP BY ALL")(lambda s, d: T.frames(t.shipments(s, d), F.floor(F.col("time") / (90 * DAY))))

# clipping

_seed = "SELECT 0::BIGINT AS time, handle, arg_max(seq, (time, seq)) AS seq, arg_max(value, (time, seq)) AS value FROM shipments, r WHERE time <= lo GROUP BY handle"
_rest = "SELECT time - lo AS time, handle, seq, value FROM shipments, r WHERE time > lo AND time <= hi"


@query("clip_full", _SR + _seed + " UNION ALL " + _rest)
def clip_full(s, d):
    c = t.shipments(s, d)
    return T.clip(c, *_range(c))


@query("clip_seed", _SR + _seed)
def clip_seed(s, d):
    c = t.shipments(s, d)
    a, _ = _range(c)
    return T.clip(c, a, a)


@query("clip_rebase", _SR + "SELECT time, handle, seq, value FROM (" + _rest + ")")
def clip_rebase(s, d):
    c = t.shipments(s, d)
    a, b = _range(c)
    return T.clip(c, a, b).where("time > 0")


_map = "m AS (SELECT handle, row_number() OVER (ORDER BY min(ord))::INT AS new_handle FROM vars WHERE regexp_matches(name, '[02468]$') GROUP BY handle) "


@query("clip_signals", with_("shipments", "vars") + ", " + _R.format("shipments") + ", " + _map + ", x AS (" + _seed + " UNION ALL " + _rest + ") SELECT time, new_handle AS handle, seq, value FROM x JOIN m USING (handle)")
def clip_signals(s, d):
    c, m = t.shipments(s, d), T.clip_handles(t.vars_(s, d), "[02468]$")
    return T.clip(T.selected(c, m), *_range(c)).join(T.small(m), "handle").select("time", F.col("new_handle").alias("handle"), "seq", "value")


query("clip_handle_map", _V + ", " + _map + "SELECT * FROM m")(lambda s, d: T.clip_handles(t.vars_(s, d), "[02468]$"))
query("scope_prune", with_("vars", "scopes") + "SELECT path FROM scopes WHERE EXISTS (SELECT 1 FROM vars WHERE regexp_matches(name, '7$') AND is_alias AND starts_with(vars.path, scopes.path || '.'))")(
    lambda s, d: T.prune_scopes(t.scopes(s, d), t.vars_(s, d).where("is_alias").where(F.col("name").rlike("7$"))).select("path")
)


# catalogue


@query(
    "meta",
    with_("changes", "vars", "scopes")
    + "SELECT 'x' AS date, 'tracemill' AS version, 'Verilog' AS file_type, '1us' AS timescale, 0::BIGINT AS timezero, (SELECT min(time) FROM changes) AS start_time, (SELECT max(time) FROM changes) AS end_time, (SELECT count(*) FROM scopes) AS num_scopes, (SELECT count(*) FROM vars) AS num_vars, (SELECT count(*) FROM vars WHERE is_alias) AS num_aliases",
)
def meta(s, d):
    v = t.vars_(s, d).agg(F.count("*").alias("num_vars"), F.count_if("is_alias").alias("num_aliases"))
    c = t.changes(s, d).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))
    # one row each
    m = F.broadcast(t.scopes(s, d).agg(F.count("*").alias("num_scopes")).withColumn("k", F.lit(1))).join(v.withColumn("k", F.lit(1)), "k").join(F.broadcast(c.withColumn("k", F.lit(1))), "k")
    return T.metadata(m.select("*", F.lit(" x\n").alias("date"), F.lit("tracemill ").alias("version"), F.lit(0).alias("file_type"), F.lit(-6).alias("timescale_exp"), F.lit(0).cast("long").alias("timezero")))


_kind = f"{_case('v.type_code', labels.VAR_TYPES)} AS type, {_case('v.direction_code', labels.DIRECTIONS)} AS direction, v.path AS name, v.length"
query("vars_all", _V + f"SELECT v.handle, {_kind}, CASE WHEN v.is_alias THEN c.path END AS alias_of FROM vars v LEFT JOIN vars c ON c.handle = v.handle AND NOT c.is_alias")(lambda s, d: T.variables(t.vars_(s, d)))
query("vars_no_alias", _V + f"SELECT v.handle, {_kind} FROM vars v WHERE NOT is_alias")(lambda s, d: T.variables(t.vars_(s, d), aliases=False))
query("var_names", _V + "SELECT path AS name FROM vars")(lambda s, d: T.variables(t.vars_(s, d)).select("name"))
query("var_names_no_alias", _V + "SELECT path AS name FROM vars WHERE NOT is_alias")(lambda s, d: T.variables(t.vars_(s, d), aliases=False).select("name"))
query("alias_of", _V + "SELECT v.path AS name, c.path AS alias_of FROM vars v JOIN vars c ON c.handle = v.handle AND NOT c.is_alias WHERE v.is_alias")(lambda s, d: T.variables(t.vars_(s, d)).where("alias_of is not null").select("name", "alias_of"))
query("scopes", with_("scopes") + f"SELECT {_case('type_code', labels.SCOPE_TYPES)} AS type, name, component FROM scopes")(lambda s, d: T.scopes(t.scopes(s, d)))
query("scope_depth", with_("scopes") + "SELECT path, depth FROM scopes")(lambda s, d: t.scopes(s, d).select("path", F.size(F.split("path", r"\.")).alias("depth")))
query("path_join", with_("scopes") + "SELECT path FROM scopes")(lambda s, d: t.scopes(s, d).select(F.concat_ws(".", F.split("path", r"\.")).alias("path")))
_sub = "CASE " + " ".join(f"WHEN type_code = {i} THEN {_case('subtype_code', n)}" for i, n in enumerate(labels.SUBTYPES)) + " END"
query("attrs", with_("attrs") + f"SELECT {_case('type_code', labels.ATTR_TYPES)} AS type, {_sub} AS subtype, name, arg, CASE WHEN type_code = 0 AND subtype_code IN (4, 5) THEN arg_from_name END AS arg_from_name FROM attrs")(lambda s, d: T.attributes(t.attrs(s, d)))
query("attr_strip", with_("attrs", "scopes") + "SELECT kind, name FROM (SELECT 'attr' AS kind, name FROM attrs UNION ALL SELECT 'scope', name FROM scopes) WHERE kind <> 'attr'")(
    lambda s, d: t.attrs(s, d).select(F.lit("attr").alias("kind"), "name").unionByName(t.scopes(s, d).select(F.lit("scope").alias("kind"), "name")).where("kind <> 'attr'")
)
query("handle_assign", _V + "SELECT path, sum((NOT is_alias)::INT) OVER (ORDER BY ord)::BIGINT AS handle FROM vars")(lambda s, d: T.assign_handles(t.vars_(s, d)).select("path", "handle"))
query("counts", with_("scopes", "vars") + "SELECT (SELECT count(*) FROM scopes) AS num_scopes, count(*) AS num_vars, count(*) FILTER (is_alias) AS num_aliases FROM vars")(
    lambda s, d: F.broadcast(t.scopes(s, d).agg(F.count("*").alias("num_scopes"), F.lit(1).alias("k"))).join(t.vars_(s, d).agg(F.count("*").alias("num_vars"), F.count_if("is_alias").alias("num_aliases"), F.lit(1).alias("k")), "k").drop("k")
)
query("time_bounds", with_("shipments") + "SELECT min(time) AS start_time, max(time) AS end_time FROM shipments")(lambda s, d: t.shipments(s, d).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time")))
query("longest_width", _V + "SELECT max(length) AS width FROM vars")(lambda s, d: t.vars_(s, d).agg(F.max("length").alias("width")))
query("distinct_handles", _V + "SELECT count(DISTINCT handle) AS n FROM vars")(lambda s, d: t.vars_(s, d).agg(F.count_distinct("handle").alias("n")))
query("section_kv", _V + "SELECT unnest(['vars', 'aliases']) AS label, unnest([count(*)::VARCHAR, count(*) FILTER (is_alias)::VARCHAR]) AS value FROM vars")(lambda s, d: T.section(t.vars_(s, d).agg(F.count("*").alias("vars"), F.count_if("is_alias").alias("aliases"))))

# blackouts

query("blackout_toggles", with_("blackouts") + "SELECT * FROM blackouts")(t.blackouts)
query("blackout_intervals", with_("blackouts") + "SELECT time AS off_from, next AS off_to FROM (SELECT *, lead(time) OVER (ORDER BY idx) AS next FROM blackouts) WHERE NOT active")(lambda s, d: T.blackout_intervals(t.blackouts(s, d)))

# functions

query("bits_to_hex", f"{_C}SELECT seq, {_hexsql} AS hex FROM (SELECT *, {_v4} FROM changes)")(lambda s, d: t.changes(s, d).select("seq", bits.to_hex(F.col("value")).alias("hex")))
query("hex_to_bits", f"{_C}SELECT seq, value AS bits FROM changes")(lambda s, d: t.changes(s, d).select("seq", bits.from_hex(bits.to_hex(F.col("value"))).alias("bits")))
query("int_to_bits", "SELECT p_partkey, right(repeat('0', 5) || bin(p_partkey), 5) AS bits FROM part")(lambda s, d: t.table(s, d, "part").select("p_partkey", bits.from_int(F.col("p_partkey"), 5).alias("bits")))
query("symbol_canon", "SELECT c_custkey, regexp_replace(lower(c_mktsegment), '[^01xzhuwl-]', '-', 'g') AS symbols FROM customer")(lambda s, d: t.table(s, d, "customer").select("c_custkey", bits.canonical_symbols(F.col("c_mktsegment")).alias("symbols")))
query("timescale_str", "SELECT p_partkey, " + _case("(p_partkey % 30 - 3)", labels.TIMESCALES) + " AS timescale FROM part")(lambda s, d: t.table(s, d, "part").select("p_partkey", labels.timescale_text(F.col("p_partkey") % 30 - 24).alias("timescale")))
query("timescale_parse", "SELECT p_partkey, " + _case("(p_partkey % 24)", labels.TIMESCALES) + " AS timescale, (p_partkey % 24 - 21)::INT AS exponent FROM part")(
    lambda s, d: t.table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, labels.TIMESCALES)), (F.col("p_partkey") % 24).cast("int")).alias("timescale")).withColumn("exponent", labels.timescale_exponent(F.col("timescale")))
)


def _enum(s, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    e = t.table(s, d, "events").agg(kinds.alias("literals"))
    return e.select(text.encode_enum(F.lit("kind"), F.col("literals"), F.transform("literals", lambda x, i: F.bin(i.cast("long"))), 3).alias("text"))


_kinds = "k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)) "
query("enum_encode", "WITH " + _kinds + "SELECT 'kind ' || count(*) || ' ' || string_agg(event_type, ' ' ORDER BY i) || ' ' || string_agg(lpad(bin(i), 3, '0'), ' ' ORDER BY i) AS text FROM k")(_enum)
query("enum_decode", "WITH " + _kinds + "SELECT 'kind' AS name, event_type AS literal, lpad(bin(i), 3, '0') AS value FROM k")(
    lambda s, d: _enum(s, d).select(text.decode_enum(F.col("text")).alias("e")).select("e.name", F.explode("e.elems").alias("x")).select("name", "x.*")
)
_digits = "CASE WHEN {0} > 0 THEN chr((33 + ({0} - 1) % 94)::INT) ELSE '' END"
_ids = "h AS (SELECT *, c_custkey + 1 AS h1 FROM customer), h2 AS (SELECT *, CASE WHEN h1 > 0 THEN (h1 - 1) // 94 ELSE 0 END AS h2 FROM h), h3 AS (SELECT *, CASE WHEN h2 > 0 THEN (h2 - 1) // 94 ELSE 0 END AS h3 FROM h2) "
query("vcd_id", "WITH " + _ids + "SELECT c_custkey, " + " || ".join(_digits.format(h) for h in ("h1", "h2", "h3")) + " AS id FROM h3")(lambda s, d: t.table(s, d, "customer").select("c_custkey", text.vcd_id(F.col("c_custkey") + 1).alias("id")))
_code = lambda h: f"(CASE WHEN {h} <= 94 THEN chr((32 + {h})::INT) WHEN {h} <= 94 * 95 THEN chr((33 + ({h} - 1) % 94)::INT) || chr((33 + (({h} - 1) // 94 - 1) % 94)::INT) ELSE chr((33 + ({h} - 1) % 94)::INT) || chr((33 + (({h} - 1) // 94 - 1) % 94)::INT) || chr((33 + ((({h} - 1) // 94 - 1) // 94 - 1) % 94)::INT) END)"
query("vcd_var_lines", _V + f"SELECT ord, '$var ' || {_case('type_code', labels.VCD_VAR_TYPES)} || ' ' || CASE WHEN type_code IN (3, 4, 20, 29) THEN 64 ELSE length END || ' ' || {_code('handle')} || ' ' || name || ' $end' AS line FROM vars")(lambda s, d: T.variable_lines(t.vars_(s, d)))
query("vcd_body_lines", _C + f"SELECT time, handle, seq, 'b' || value || ' ' || {_code('handle')} AS line FROM changes UNION ALL SELECT DISTINCT time, 0, 0, '#' || time FROM changes")(
    lambda s, d: T.value_lines(t.changes(s, d)).select("time", "ord.handle", "ord.seq", "line")
)
query("vcd_time_marks", with_("shipments") + "SELECT DISTINCT '#' || time AS line FROM shipments")(lambda s, d: T.value_lines(t.shipments(s, d)).where("ord.handle = 0").select("line"))
_esc = "CASE v " + " ".join(f"WHEN {b} THEN '{e.replace(chr(39), chr(39) * 2)}'" for b, e in text.ESCAPES.items()) + r" ELSE CASE WHEN v BETWEEN 33 AND 126 THEN chr(v) ELSE '\' || (v // 64) || ((v // 8) % 8) || (v % 8) END END"
query("text_escape", f"SELECT page_id, (SELECT string_agg({_esc}, '' ORDER BY i) FROM (SELECT i, ('0x' || substr(hex(url), 2 * i + 1, 2))::INT AS v FROM range(strlen(url)) x(i))) AS text FROM pages")(lambda s, d: t.table(s, d, "pages").select("page_id", text.escape_text(F.col("url").cast("binary")).alias("text")))
query("text_unescape", "SELECT doc_id, text FROM documents")(lambda s, d: t.table(s, d, "documents").select("doc_id", text.unescape_text(text.escape_text(F.col("text").cast("binary"))).cast("string").alias("text")))
query("real_text", "SELECT l_orderkey, l_linenumber, printf('%.16g', l_extendedprice) AS text FROM lineitem")(lambda s, d: t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.real_text(F.col("l_extendedprice")).alias("text")))
query("supvar_pack", "SELECT p_partkey, ((p_size % 6) << 10) | (p_partkey % 17)::INT AS packed, p_size % 6 AS svt, (p_partkey % 17)::INT AS sdt FROM part")(
    lambda s, d: t.table(s, d, "part").select("p_partkey", text.pack_supplement(F.col("p_size") % 6, (F.col("p_partkey") % 17).cast("int")).alias("packed")).select("p_partkey", "packed", text.unpack_supplement(F.col("packed"))[0].alias("svt"), text.unpack_supplement(F.col("packed"))[1].alias("sdt"))
)
query("one_line", "SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM documents")(lambda s, d: t.table(s, d, "documents").select("doc_id", text.one_line(F.col("text")).alias("text")))

_stems = "s AS (SELECT o_orderkey AS ord, o_orderpriority || o_orderstatus AS path, o_custkey AS line FROM orders) "
query("source_stems", "WITH " + _stems + ", f AS (SELECT path, min(ord) AS first_ord FROM s GROUP BY path), i AS (SELECT *, row_number() OVER (ORDER BY first_ord)::INT AS path_id FROM f) SELECT ord, path, line, path_id, ord = first_ord AS first FROM s JOIN i USING (path)")(
    lambda s, d: T.source_stems(t.table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", "o_orderstatus").alias("path"), F.col("o_custkey").alias("line")))
)
query("blackout_marks", with_("changes", "blackouts") + "SELECT time, '$dump' || CASE WHEN active THEN 'on' ELSE 'off' END || ' $end' AS line FROM blackouts WHERE time IN (SELECT time FROM changes)")(
    lambda s, d: T.value_lines(t.changes(s, d).select("time", "handle", "seq", "value"), t.blackouts(s, d)).where("ord.handle = 0 and ord.seq > 0").select("time", "line")
)

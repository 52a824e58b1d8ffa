"""Records of a producer, reports, matchers, closures, SQL functions, tables of literals, source stems, side files."""

import struct

import pytest
from pyspark.sql import functions as F

from tracemill.functions import bits, text
from tracemill.operators import report as R
from tracemill.operators import trace as T
from tracemill.sources import blocks as B
from tracemill.sources.records import Records
from tracemill.sources.waveform import read_trace, write_trace


def _records():
    r = Records()
    r.comment("made\nby hand")
    r.environment("HOME=/x")
    r.value_list("0 1 x z")
    r.scope("top", 99)
    table = r.enum_table("state", [("idle now", "0"), ("run", "1"), ("s\\t", "10")], 3)
    assert (table, r.enum_table("none", []), r.enum_table("other", [("a", "1")])) == (1, 0, 2)
    r.source("/src/a.v", 10)
    r.enum_reference(table)
    assert r.variable(16, "s", 3) == 1
    r.source("/src/b.v", 4, instantiation=True)
    r.scope("u")
    r.source("/src/a.v", 12)
    assert r.variable(16, "c", 1, supplement=("std_logic", 4, 1030)) == 2
    assert r.variable(16, "alias", 3, alias=1) == 1
    assert r.variable(16, "beyond", 1, alias=9) == 3
    assert r.variable(3, "r", 99) == 4
    r.upscope()
    r.upscope()
    r.attribute(77, 3, "odd", 5)
    r.attribute_end()
    return r


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    changes = [(t, h, i, v) for i, (t, h, v) in enumerate([(0, 1, "000"), (0, 2, "0"), (3, 1, "001"), (5, 2, "1"), (5, 3, "1"), (7, 1, "010"), (9, 2, "0"), (12, 2, "1")])]
    c = spark.createDataFrame(changes, "time long, handle int, seq long, value string")
    r = _records()
    hier = r.frame(spark)
    meta = spark.createDataFrame([("d", "v", 0, -9, 0, 0, 12, 0, 0, 0, 0)], "date string, version string, file_type int, timescale_exp int, timezero long, start_time long, end_time long, num_scopes long, num_vars long, num_aliases long, max_handle long")
    path = str(tmp_path_factory.mktemp("r") / "r.trace")
    write_trace(T.Trace(T.recounted(meta, hier), hier, c, spark.createDataFrame([(0, 4, False), (1, 7, True), (2, 12, False)], "idx int, time long, active boolean")), path, block_changes=3)
    return read_trace(spark, path), r, path


def test_records(trace):
    got, r, _ = trace
    assert [(x.ord, x.kind, x.name, x.depth, x.path) for x in got.hier.orderBy("ord").collect()] == [(x["ord"], x["kind"], x.get("name"), x["depth"], x["path"]) for x in r.rows]
    assert [(v.name, v.handle, v.is_alias, v.length) for v in got.vars.orderBy("ord").collect()] == [("s", 1, False, 3), ("c", 2, False, 1), ("alias", 1, True, 3), ("beyond", 3, False, 1), ("r", 4, False, 8)]
    assert got.hier.where("kind = 'scope'").orderBy("ord").first().type_code == 0
    attrs = [(x.type, x.subtype, x.name, x.arg, x.arg_from_name) for x in T.attributes(got.hier.where("kind = 'attr'").orderBy("ord")).collect()]
    assert attrs[:3] == [("Misc", "Comment", "made by hand", 0, None), ("Misc", "EnvVar", "HOME=/x", 0, None), ("Misc", "ValueList", "0 1 x z", 0, None)]
    assert attrs[-1] == ("Misc", "Unknown", "odd", 5, None) and ("Misc", "SupVar", "std_logic", 4 << 10 | 6, None) in attrs
    assert [x[1:] for x in attrs if "Path" in x[1] or "Stem" in x[1]] == [
        ("PathName", "/src/a.v", 1, None), ("SourceStem", "", 10, 1), ("PathName", "/src/b.v", 2, None), ("SourceIStem", "", 4, 2), ("SourceStem", "", 12, 1),
    ]
    stems = T.resolve_stems(got.hier.where("kind = 'attr'")).orderBy("ord").collect()
    assert [(s.path, s.line) for s in stems] == [("/src/a.v", 10), ("/src/b.v", 4), ("/src/a.v", 12)]


def test_enum_tables(spark, trace):
    got = [(r.handle, r.path, r.table, r.literal, r.value) for r in R.enum_values(trace[0].hier).collect()]
    assert sorted(got) == [(1, "top.s", "state", "idle now", "000"), (1, "top.s", "state", "run", "001"), (1, "top.s", "state", "s\\t", "010")]
    both = spark.createDataFrame([(["a b", "é"], ["0", "11"]), ([], [])], "l array<string>, v array<string>").select(text.encode_enum(F.lit("n"), F.col("l"), F.col("v"), 4).alias("t"))
    back = [r.e for r in both.select(text.decode_enum(F.col("t")).alias("e")).collect()]
    assert [tuple(x) for x in back[0].elems] == [("a b", "0000"), ("é", "0011")] and back[1] is None
    assert both.first().t.startswith("n 2 a\\040b ")


def test_sections(trace):
    got = trace[0]
    assert list(R.sections(got, all_sections=True)) == ["metadata", "vars", "scopes", "attributes"]
    chosen = R.sections(got, vars=True, scopes=True, aliases=False, names_only=True)
    assert list(chosen) == ["var_names_no_alias", "scopes"] and sorted(r.name for r in chosen["var_names_no_alias"].collect()) == ["top.s", "top.u.beyond", "top.u.c", "top.u.r"]
    said = R.printed(R.sections(got, metadata=True, scopes=True)).split("\n\n")
    assert len(said) == 2 and "Metadata" in said[0].split("\n")[1] and any(x.startswith("│ end_time ") and " 12" in x for x in said[0].split("\n"))
    assert len({len(x) for x in said[0].split("\n")}) == 1
    assert "None" in R.titled("Scopes", T.scopes(got.hier.limit(0)))
    with pytest.raises(T.TraceError):
        R.sections(got)


def test_matchers_and_printers(trace, monkeypatch):
    got = trace[0]
    lines = lambda *a, **k: sorted(r.text for r in R.matches(got, *a, **k).collect())
    assert lines("bits", "1") == ["#3 top.s 001", "#5 top.u.beyond 1", "#5 top.u.c 1"]
    assert lines("hex", "2", printer="names") == ["top.s"] and lines("regex", "^0$", all_matches=True, signals="c$") == ["#0 top.u.c 0", "#9 top.u.c 0"]
    monkeypatch.setitem(R.MATCHERS, "ends", lambda value, wanted: value.endswith(wanted))
    monkeypatch.setitem(R.PRINTERS, "short", lambda hits: hits.select(F.concat_ws("@", "value", "time").alias("text")))
    assert lines("ends", "10", printer="short") == ["010@7"]


def test_closure_per_signal(spark, trace):
    def toggles(handle, changes):
        last, n = None, 0
        for time, value, _ in changes:
            if last is not None and value != last:
                n += 1
                yield handle, time, n
            last = value

    rows = R.per_signal(trace[0].changes.where("not is_initial"), toggles, "handle int, time long, n int").collect()
    assert sorted(map(tuple, rows)) == [(1, 3, 1), (1, 7, 2), (2, 5, 1), (2, 9, 2), (2, 12, 3)]
    many = spark.range(20_000).select(F.col("id").alias("time"), (F.col("id") % 7).cast("int").alias("handle"), F.col("id").alias("seq"), F.bin(F.col("id")).alias("value"))
    count = R.per_signal(many, lambda h, c: [(h, sum(1 for _ in c))], "handle int, n long", 3)
    assert sorted(map(tuple, count.collect())) == sorted((h, len(range(h, 20_000, 7))) for h in range(7))


def test_sql_functions(spark, trace):
    R.register(spark, trace[0], "t")
    assert {(r.handle, r.value) for r in spark.sql("SELECT * FROM t_at(6)").collect()} == {(1, "001"), (2, "1"), (3, "1")}
    values = spark.createDataFrame([("10110",), ("x1",), ("",)], "v string")
    values.createOrReplaceTempView("v")
    assert [r[0] for r in spark.sql("SELECT value_hex(v) FROM v").collect()] == [r[0] for r in values.select(bits.to_hex(F.col("v"))).collect()]
    assert spark.sql("SELECT count(*) FROM t_changes JOIN t_vars USING (handle) WHERE value_is(value, '01') AND NOT is_alias").first()[0] == 4


def test_blackout_times_and_initial_lines(trace):
    got = trace[0]
    assert sorted((r.time, r.handle) for r in R.during_blackouts(got.changes, got.blackouts).collect()) == [(5, 2), (5, 3), (12, 2)]
    lines = [r.line for r in T.initial_lines(got.vars, T.value_at(got.changes.where("not is_initial"), 0)).orderBy("ord").collect()]
    assert lines == ["$dumpvars", "b000 !", '0"', "x#", "rnan $", "$end"]


@pytest.mark.parametrize("bucket", [None, 3, 100])
def test_values_at_buckets(spark, bucket):
    c = spark.createDataFrame([(t, t % 2, t, f"v{t}") for t in range(4, 40, 3)] + [(9, 0, 99, "late")], "time long, handle int, seq long, value string")
    points = spark.createDataFrame([(h, at) for h in (0, 1, 5) for at in range(0, 60, 5)], "handle int, at long")
    rows = sorted((r.time, r.seq, r.handle, r.value) for r in c.collect())
    want = {(h, at): next((v for t, _, x, v in reversed(rows) if x == h and t <= at), None) for h in (0, 1, 5) for at in range(0, 60, 5)}
    assert {(r.handle, r.at): r.value for r in T.values_at(c, points, bucket).collect()} == want


def test_word_vectors(spark):
    df = spark.createDataFrame([([5, 1],), ([0xFFFFFFFF, 0],), ([],)], "w array<long>")
    assert [r[0] for r in df.select(bits.from_words(F.col("w"), 35)).collect()] == [f"{(1 << 32) + 5:035b}", f"{0xFFFFFFFF:035b}", "0" * 35]


def test_side_file_and_checks(spark, trace, tmp_path):
    """A hierarchy in a file beside; blocks beyond the header's count; a header without handles."""
    _, r, path = trace
    with open(path, "rb") as f:
        raw = f.read()
    at, kept, head = 0, b"", b""
    while at < len(raw):
        tag, size = raw[at], struct.unpack(">Q", raw[at + 1 : at + 9])[0] + 1
        head = raw[at : at + size] if tag == B.HEADER else head
        kept += b"" if tag in (B.HIERARCHY, B.HIERARCHY_LZ4, B.HIERARCHY_LZ4_TWICE) else raw[at : at + size]
        at += size
    own = str(tmp_path / "s.trace")
    with open(own, "wb") as f:
        f.write(kept)
    with open(own, "rb") as f, pytest.raises(B.FormatError):
        B.File(f)
    with open(f"{own}.hier", "wb") as f:
        f.write(B.hierarchy_bytes(r.rows))
    rows = lambda p: sorted(map(str, read_trace(spark, p).changes.collect()))
    assert rows(own) == rows(path)
    blocks = struct.unpack(">Q", head[9 + 56 : 9 + 64])[0]
    assert blocks > 1
    for place, n in ((56, blocks - 1), (48, 0)):
        with open(own, "wb") as f:
            f.write(kept.replace(head, head[: 9 + place] + struct.pack(">Q", n) + head[9 + place + 8 :]))
        if n:
            assert 0 < len(rows(own)) < len(rows(path))
        else:
            with pytest.raises(Exception, match="no handles"):
                rows(own)

"""The documented example, aliases, repeats at one time, reals, and functions, with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import bits, labels, text
from tracemill.operators import trace as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def example(spark):
    changes = spark.createDataFrame([(0, 1, 0, "10001000"), (10, 1, 1, "10011100"), (42, 1, 2, "00111001")], "time long, handle int, seq long, value string")
    vars_ = spark.createDataFrame([(1, "var", 5, 2, "var", "var", 8, 1, False)], "ord long, kind string, type_code int, direction_code int, name string, path string, length int, handle int, is_alias boolean")
    return changes, vars_


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(
        [(1, "clk", "top.clk", 1, False), (3, "clk_i", "top.u0.clk_i", 1, True), (4, "data", "top.u0.data", 2, False)],
        "ord long, name string, path string, handle int, is_alias boolean",
    )


@pytest.mark.parametrize(
    ("wanted", "how", "found"),
    [
        ("10011100", {}, [10]), ("9c", {"hexadecimal": True}, [10]), ("9C", {"hexadecimal": True}, [10]), ("0010011100", {}, [10]), ("^0", {"regex": True}, [42]),
        ("^8", {"regex": True, "hexadecimal": True}, [0]), (".", {"regex": True}, [0]), (".", {"regex": True, "all_matches": True}, [0, 10, 42]), ("111", {}, []),
    ],
)
def test_find(example, wanted, how, found):
    assert [r[0] for r in rows(T.find(*example, wanted, **how).select("time"))] == found


def test_lines(example):
    hits = T.find(*example, "10011100")
    assert T.hit_lines(hits).first()[0] == "#10 var 10011100"
    assert T.hit_lines(hits, names_only=True).first()[0] == "var"


@pytest.mark.parametrize(("bad", "hexadecimal"), [("12", False), ("g", True)])
def test_bad_literals(bad, hexadecimal):
    with pytest.raises(bits.LiteralError):
        bits.bits_of_literal(bad, hexadecimal)


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)b", r"(a)\1"])
def test_bad_patterns(bad):
    with pytest.raises(bits.LiteralError):
        bits.checked_pattern(bad)


@pytest.mark.parametrize(("at", "value"), [(9, "10001000"), (10, "10011100"), (41, "10011100"), (100, "00111001"), (-1, None)])
def test_value_at(spark, example, at, value):
    assert [r.value for r in T.value_at(example[0], at).collect()] == ([value] if value else [])
    points = spark.createDataFrame([(1, at)], "handle int, at long")
    assert T.values_at(example[0], points).first().value == value


@pytest.mark.parametrize(("start", "end", "want"), [(20, 50, [(0, "10011100"), (22, "00111001")]), (10, 42, [(0, "10011100"), (32, "00111001")]), (60, 70, [(0, "00111001")])])
def test_clip(example, start, end, want):
    assert rows(T.clip(example[0], start, end).select("time", "value")) == want


@pytest.mark.parametrize(("start", "end"), [(50, 20), (0, 101), (-1, 5)])
def test_clip_range(start, end):
    with pytest.raises(T.TraceError):
        T.check_range(start, end, 0, 100)


def test_clip_repeats(spark):
    c = spark.createDataFrame([(5, 1, 0, "0"), (5, 1, 1, "1"), (5, 1, 2, "0")], "time long, handle int, seq long, value string")
    assert rows(T.clip(c, 5, 9).select("time", "value")) == [(0, "0")]
    assert rows(T.clip(c, 0, 5).select("time", "seq", "value")) == [(5, 0, "0"), (5, 1, "1"), (5, 2, "0")]
    assert T.value_at(c, 5).first().value == "0"


def test_names_and_handles(nested):
    assert rows(T.preferred_names(nested, "u0")) == [(1, "top.u0.clk_i"), (2, "top.u0.data")]
    assert rows(T.preferred_names(nested, "clk")) == [(1, "top.clk")]
    assert rows(T.clip_variables(nested, "clk_i").select("path", "handle", "is_alias")) == [("top.u0.clk_i", 1, False)]
    with pytest.raises(T.TraceError):
        T.clip_handles(nested, "u0")  # own names only


def test_scope_pruning(spark, nested):
    scopes = spark.createDataFrame([("top",), ("top.u0",), ("top.idle",)], "path string")
    assert rows(T.prune_scopes(scopes, nested.where("name = 'clk_i'"))) == [("top",), ("top.u0",)]


def test_blackouts(spark):
    toggles = spark.createDataFrame([(0, 0, True), (1, 20, False), (2, 40, True)], "idx int, time long, active boolean")
    assert rows(T.blackout_intervals(toggles)) == [(20, 40)]


def test_hex_view(spark):
    df = spark.createDataFrame([("x1z0",), ("10000",), ("",), ("z" * 130,)], "v string")
    assert [r[0] for r in df.select(bits.to_hex(F.col("v"))).collect()] == ["e", "10", "", "3" + "f" * 32]
    assert df.where(bits.equals_bits(F.col("v"), "")).count() == 1


def test_functions(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("x")).first().x
    assert [first(text.vcd_id(F.lit(h))) for h in (1, 94, 95, 96)] == ["!", "~", "!!", '"!']
    assert text.escape(b"a b\n\xc3\xa9?") == r"a\040b\n\303\251\?"
    assert text.unescape(r"a\040b\n\303\251\?\x41\q") == b"a b\n\xc3\xa9?Aq"
    assert text.unescape(text.escape(bytes(range(256)))) == bytes(range(256))
    want = {"10ns": -8, "100ps": -10, "1s": 0, "1ms": -3, "5us": -6, "": -9}
    assert {k: first(labels.timescale_exponent(F.lit(k))) for k in want} == want
    assert [first(labels.timescale_text(F.lit(e))) for e in (-9, -21, 2, 3)] == ["1ns", "1zs", "100s", "Unknown"]
    assert first(text.decode_enum(F.lit("state 2 IDLE RUN 00 01"))).asDict(True) == {"name": "state", "elems": [{"literal": "IDLE", "value": "00"}, {"literal": "RUN", "value": "01"}]}
    assert first(text.decode_enum(F.lit("state 2 IDLE RUN 00"))) is None
    assert [first(bits.from_int(F.lit(5).cast("long"), n)) for n in (8, 2)] == ["00000101", "01"]
    assert first(text.pack_supplement(F.lit(1), F.lit(7))) == 1031
    assert [first(text.real_text(F.lit(x))) for x in (0.1, 100000.0, 1e22)] == ["0.1", "100000", "1e+22"]
    assert first(bits.from_hex(F.lit("9c"))) == "10011100"


def test_vcd(spark):
    meta = spark.createDataFrame([(" today\n", "v", -10, 5)], "date string, version string, timescale_exp int, timezero long")
    hier = spark.createDataFrame(
        [(0, "scope", 0, None, "top", None, None, None), (1, "var", 16, None, "clk", 1, 1, None), (2, "var", 3, None, "r", 8, 2, None), (3, "attr", 0, 0, "note", None, None, 7), (4, "attr_end", None, None, None, None, None, None), (5, "upscope", None, None, None, None, None, None)],
        "ord long, kind string, type_code int, subtype_code int, name string, length int, handle int, arg long",
    )
    lines = [r.line for r in T.header_lines(meta, hier, extensions=True).orderBy("ord").collect()]
    assert lines == [
        "$date today $end", "$version v $end", "$timezero 5 $end", "$timescale 100ps $end", "$scope module top $end", "$var wire 1 ! clk $end", "$var real 64 \" r $end",
        "$attrbegin misc 00 note 7 $end", "$attrend $end", "$upscope $end", "$enddefinitions $end",
    ]
    changes = spark.createDataFrame(
        [(5, 1, 0, "z", None, None, False), (5, 2, 0, "0.1", None, 0.1, False), (7, 3, 0, "01zu", None, None, False), (7, 4, 0, "", bytearray(b"a b"), None, True)],
        "time long, handle int, seq long, value string, raw binary, real_value double, var_len boolean",
    )
    toggles = spark.createDataFrame([(0, 7, False), (1, 8, True)], "idx int, time long, active boolean")
    body = [r.line for r in T.value_lines(changes, toggles).orderBy("time", "ord").collect()]
    assert body == ["#5", "z!", 'r0.1 "', "#7", "$dumpoff $end", "p01zu #", r"sa\040b $"]


def test_stems(spark):
    stems = spark.createDataFrame([(1, "b.v", 10), (2, "a.v", 5), (3, "b.v", 12)], "ord long, path string, line long")
    assert rows(T.source_stems(stems)) == [(1, "b.v", 10, 1, True), (2, "a.v", 5, 2, True), (3, "b.v", 12, 1, False)]
    attrs = spark.createDataFrame([(0, 0, 3, "b.v", 1, None), (1, 0, 4, "", 10, 1)], "ord long, type_code int, subtype_code int, name string, arg long, arg_from_name long")
    assert rows(T.resolve_stems(attrs)) == [(1, "b.v", 10)]


def test_null_real_and_null_handle(spark):
    rows = spark.createDataFrame([(1, None), (None, 0.5), (2, float("nan"))], "handle int, x double")
    assert {r[0] for r in rows.select(text.real_text(F.col("x"))).collect()} == {None, "0.5", "nan"}
    handles = spark.createDataFrame([(1,), (None,)], "handle int")
    many = handles.unionByName(spark.range(10, 2000).select(F.col("id").cast("int").alias("handle")))
    for h in (handles, many):
        assert [r.handle for r in T.selected(rows, h).collect()] == [1]
        assert {r.handle for r in T.selected(rows, h, keep=False).collect()} == {None, 2}


def test_frames_carry_values_on(spark):
    c = spark.createDataFrame([(0, 1, 0, "a"), (5, 2, 1, "b"), (12, 1, 2, "c"), (35, 3, 3, "d")], "time long, handle int, seq long, value string")
    got = {(r.block, r.handle): r.value for r in T.frames(c, F.floor(F.col("time") / 10)).collect()}
    assert got == {(0, 1): "a", (0, 2): "b", (1, 1): "c", (1, 2): "b", (3, 1): "c", (3, 2): "b", (3, 3): "d"}

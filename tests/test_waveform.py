"""Round trips of trace files, with pruning, aliases, reals, texts and several blocks; FastLZ by hand-made data."""

import gzip
import pickle
import re
import struct

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import trace as T
from tracemill.sources import blocks as B
from tracemill.sources import waveform as W
from tracemill.sources.waveform import read_trace, write_trace

VAR = dict.fromkeys("subtype_code component arg arg_from_name".split())


def _hier():
    var = lambda ty, name, length, handle, alias=False: VAR | {"kind": "var", "type_code": ty, "direction_code": 1, "name": name, "length": length, "handle": handle, "is_alias": alias}
    scope = lambda name: {"kind": "scope", "type_code": 0, "name": name, "component": ""}
    up = {"kind": "upscope"}
    return [
        {"kind": "attr", "type_code": 0, "subtype_code": 0, "name": "a\nb", "arg": 300}, scope("top"), var(16, "clk", 1, 1), scope("u0"), var(16, "clk_i", 1, 1, True), var(5, "data", 65, 2), up,
        var(3, "r", 8, 3), var(21, "s", 0, 4), up, up, var(5, "same", 65, 5), {"kind": "attr", "type_code": 0, "subtype_code": 4, "name": "", "arg": 7, "arg_from_name": 1000}, {"kind": "attr_end"},
    ]


def _changes():
    out = []
    for t in range(200):
        out.append((t * 3, 1, b"01xzhuwl-"[t % 9 : t % 9 + 1]))
        for h in (2, 5):
            out.append((t * 3, h, (bin(t * 7919)[2:].zfill(65) if t % 4 else "z" * 65).encode()))
        out.append((t * 3, 3, struct.pack("<d", t / 7)))
        out.append((t * 3, 4, f"é {t}".encode()))
        out.append((t * 3, 1, b"1"))
    return out


@pytest.mark.parametrize("kind", ["4", "Z"])
@pytest.mark.parametrize("size", [10_000, 300])
def test_round_trip(spark, tmp_path, kind, size):
    path, meta = str(tmp_path / "t.trace"), {"date": "today", "version": "v", "timescale_exp": -12, "timezero": -5, "start_time": 0}
    with open(path, "wb") as f:
        f.writelines(B.file_bytes(meta, _hier(), _changes(), [(0, True), (30, False), (90, True)], kind, size))
    if size == 300:  # the wrapped form of the same
        with open(path, "rb") as f:
            raw = f.read()
        with open(path, "wb") as f:
            f.write(bytes([B.WRAPPER]) + struct.pack(">QQ", len(raw), len(raw)) + gzip.compress(raw))
    trace = read_trace(spark, path)
    got = [(r.time, r.handle, bytes(r.raw)) for r in trace.changes.where("not is_initial").orderBy("handle", "time", "seq").collect()]
    assert got == sorted(_changes(), key=lambda c: (c[1], c[0]))
    assert trace.changes.where("is_initial").count() == 0
    m = trace.metadata.first()
    assert (m.date, m.version, m.timescale_exp, m.timezero, m.start_time, m.end_time, m.num_vars, m.num_aliases, m.num_scopes) == ("today", "v", -12, -5, 0, 597, 6, 1, 2)
    assert [r.path for r in trace.vars.orderBy("ord").collect()] == ["top.clk", "top.u0.clk_i", "top.u0.data", "top.r", "top.s", "same"]
    assert [(r.idx, r.time, r.active) for r in trace.blackouts.collect()] == [(0, 0, True), (1, 30, False), (2, 90, True)]
    attr = trace.hier.where("kind = 'attr'").orderBy("ord").collect()
    assert [(r.name, r.arg, r.arg_from_name) for r in attr] == [("a b", 300, None), ("", 7, 1000)]
    assert trace.changes.where("handle = 3 and time = 21").first().real_value == 1.0


def test_limits_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t.trace")
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, _hier(), _changes(), (), "4", 300))
    whole = read_trace(spark, path).changes
    late = read_trace(spark, path, start="400", signals="data").changes
    first = late.where("is_initial").collect()
    assert [r.handle for r in first] == [2]
    before = whole.where((F.col("handle") == 2) & (F.col("time") <= first[0].time)).agg(F.max_by("value", F.struct("time", "seq"))).first()[0]
    assert first[0].value == before
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        want = [r for r in whole.collect() if 100 <= r.time <= 130 and r.handle in (1, 2)]
        got = read_trace(spark, path).changes.where("time between 100 and 130 and handle in (1, 2)").collect()
        assert sorted(got) == sorted(want) and len(got) == 30
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_clip_to_file(spark, tmp_path):
    path, out = str(tmp_path / "t.trace"), str(tmp_path / "c.trace")
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, _hier(), _changes(), (), "4", 300))
    trace = read_trace(spark, path)
    part = trace.clip(30, 60, "data|^r$")
    write_trace(part, out)
    again = read_trace(spark, out)
    m = again.metadata.first()
    assert (m.timezero, m.start_time, m.end_time, m.max_handle) == (30, 0, 30, 2)
    assert sorted(r.path for r in part.hier.where("kind = 'scope'").collect()) == ["top", "top.u0"]
    at = {r.handle: r.value for r in T.value_at(again.changes, 12).collect()}
    want = {r.handle: r.value for r in T.value_at(trace.changes, 42).collect()}
    assert at == {1: want[2], 2: want[3]}


def test_writer_of_many_blocks(spark, tmp_path):
    """Blocks that tasks build equal the trace, each with the state before it, also for values without raw bytes."""
    path, out = str(tmp_path / "t.trace"), str(tmp_path / "c.trace")
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, _hier(), _changes(), [(3, False), (9, True)], "4", 10_000))
    trace = read_trace(spark, path)
    write_trace(trace, out, block_changes=100)
    with open(out, "rb") as f:
        file = B.File(f)
        assert len(file.values) > 8
        state = {}
        for i, b in enumerate(file.values):
            got = list(B.block_changes(file, i, None, True))
            shown = {r[1]: r[4] for r in got if r[7]}
            assert all(shown[h] == state.get(h, struct.pack("<d", float("nan")) if h == 3 else b"x" * len(shown[h])) for h in shown)
            state |= {r[1]: r[4] for r in got if not r[7]}
            assert b.begin <= b.end
    again = read_trace(spark, out)
    columns = ["time", "handle", "value", "raw", "real_value", "var_len"]
    rows = lambda t: sorted(map(str, t.changes.select(columns).collect()))
    assert rows(again) == rows(trace) and again.blackouts.collect() == trace.blackouts.collect() and _records(again.hier) == _records(trace.hier)
    plain = T.Trace(trace.metadata, trace.hier, trace.changes.where("handle <> 3").withColumn("value", F.coalesce("value", F.col("raw").cast("string"))).drop("raw"), trace.blackouts)
    write_trace(plain, out)
    assert sorted(map(str, read_trace(spark, out).changes.select(columns).collect())) == sorted(map(str, trace.changes.where("handle <> 3").select(columns).collect()))
    with pytest.raises(T.TraceError):
        write_trace(T.Trace(trace.metadata, trace.hier, trace.changes.withColumn("handle", F.lit(99)), trace.blackouts), out)
    write_trace(T.Trace(trace.metadata, trace.hier, trace.changes.limit(0), trace.blackouts), out)
    assert read_trace(spark, out).changes.count() == 0


def test_writer_of_many_signals(spark, tmp_path, monkeypatch):
    """Blocks are as many as signals allow, states come by ranges of signals, records and toggles by tasks; no content goes through the driver."""
    monkeypatch.setattr(W, "_STATES", 20_000)
    monkeypatch.setattr(W, "_WHOLE", 1000)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    path, out, n = str(tmp_path / "t.trace"), str(tmp_path / "c.trace"), 300
    hier = [VAR | {"kind": "var", "type_code": 21 if i % 7 == 0 else 3 if i % 5 == 0 else 16, "direction_code": 0, "name": f"s{i}", "length": 8 if i % 5 == 0 else 1 + i % 9, "handle": i, "is_alias": False} for i in range(1, n + 1)]
    widths = B.widths_of(hier)
    value = lambda h, t: struct.pack("<d", t / 3) if widths[h - 1] == 0 else f"x{t}".encode() if widths[h - 1] == B.TEXT_LENGTH else bin(t * 7919 + h | 1 << 20)[-widths[h - 1] :].encode()
    changes = [(t // 3, t * 37 % 211 + 1, value(t * 37 % 211 + 1, t)) for t in range(900)]
    toggles = [(t * t, t % 2 == 1) for t in range(60)]
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, hier, changes, toggles))
    trace = read_trace(spark, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts stay apart
    try:
        write_trace(trace, out, block_changes=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with open(out, "rb") as f:
        file = B.File(f)
        assert not {"widths", "hierarchy", "blackouts"} & set(vars(file))  # they are read when they are asked for
        assert 3 < len(file.values) <= 900 // (n // W.SIGNALS_A_CHANGE)
        state = {}
        for i in range(len(file.values)):
            got = list(B.block_changes(file, i, None, True))
            shown = {r[1]: r[4] for r in got if r[7]}
            assert len(shown) == sum(w != B.TEXT_LENGTH for w in widths)
            assert all(shown[h] == state.get(h, struct.pack("<d", float("nan")) if widths[h - 1] == 0 else b"x" * len(shown[h])) for h in shown)
            state |= {r[1]: r[4] for r in got if not r[7]}
        assert [x[1:] for x in file.blackouts] == toggles and file._records[0] == B.HIERARCHY
    again = read_trace(spark, out)
    rows = lambda t: sorted(map(str, t.changes.select("time", "handle", "raw").collect()))
    assert rows(again) == rows(trace) and again.hier.collect() == trace.hier.collect() and len(rows(again)) == 900
    assert not list(tmp_path.glob("*.p*"))
    with pytest.raises(T.TraceError):
        write_trace(T.Trace(trace.metadata, trace.hier, trace.changes.withColumn("handle", F.lit(n + 1)), trace.blackouts), out)


def test_selection_in_bits(tmp_path):
    """A selection of signals travels to each block's task as a bit for each handle."""
    path, n = tmp_path / "t.trace", 4000
    hier = [VAR | {"kind": "var", "type_code": 16, "direction_code": 0, "name": f"s{i}", "length": 1, "handle": i, "is_alias": False} for i in range(1, n + 1)]
    path.write_bytes(b"".join(B.file_bytes({"start_time": 0}, hier, [(t, t * 7 % n + 1, b"1") for t in range(500)])))
    (part,) = W._Reader(str(path), {"signals": "[13579]$"}).partitions()
    assert len(pickle.dumps(part)) < n // 8 + 1000
    assert [h for h in range(n + 99) if h in part.wanted] == list(range(1, n + 1, 2))
    assert 5 not in B.Handles([]) and 5 in B.Handles([900, 5])


def _records(hier):
    """kind, name, path and depth of the records in order, as a reader sees them."""
    return [(r.kind, r.name, r.path, r.depth) for r in hier.orderBy("ord").collect()]


def test_clip_hierarchy(spark, tmp_path):
    """Nested, sibling, repeated and empty scopes, with and without a filter, after a round trip."""
    var = lambda name, handle, alias=False: VAR | {"kind": "var", "type_code": 16, "direction_code": 0, "name": name, "length": 1, "handle": handle, "is_alias": alias}
    scope = lambda name: {"kind": "scope", "type_code": 0, "name": name, "component": ""}
    attr, end, up = {"kind": "attr", "type_code": 0, "subtype_code": 0, "name": "note", "arg": 1}, {"kind": "attr_end"}, {"kind": "upscope"}
    hier = [
        var("a0", 1), scope("top"), attr, scope("u0"), var("b", 2), end, up, scope("empty"), up, scope("u0"), var("a1", 3), scope("deep"), scope("er"), var("a2", 3, True), up, var("c", 4), up, up,
        var("a3", 5), scope("u1"), var("d", 6), up, up, scope("top"), var("e", 7), up, scope("top"), var("a4", 8), up, var("a5", 1, True),
    ]
    path, out = str(tmp_path / "t.trace"), str(tmp_path / "c.trace")
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, hier, [(t, h, b"01"[(t * h) % 2 :][:1]) for t in range(9) for h in range(1, 9)]))
    trace = read_trace(spark, path)
    for signals, attributes, count in ((None, True, 10), (None, False, 10), ("^a", True, 6), ("^a", False, 6), ("^[be]$", True, 2)):
        part = trace.clip(2, 7, signals, attributes)
        write_trace(part, out)
        again = read_trace(spark, out)
        # brute force, record by record
        want, stack, left = [], [], []
        for r in hier:
            if r["kind"] == "scope":
                left.append([r["name"], False])
            elif r["kind"] == "upscope":
                if left.pop()[1] or signals is None:
                    want.append(("upscope", None, ".".join(stack), len(stack)))
                    stack.pop()
            elif r["kind"] == "var" and (signals is None or re.search(signals, r["name"])):
                for s in left:
                    if not s[1]:
                        s[1] = True
                        want.append(("scope", s[0], ".".join([*stack, s[0]]), len(stack)))
                        stack.append(s[0])
                want.append(("var", r["name"], ".".join([*stack, r["name"]]), len(stack)))
            elif r["kind"] in ("attr", "attr_end") and attributes:
                want.append((r["kind"], r.get("name"), ".".join(stack), len(stack)))
            if r["kind"] == "scope" and signals is None:
                left[-1][1] = True
                want.append(("scope", r["name"], ".".join([*stack, r["name"]]), len(stack)))
                stack.append(r["name"])
        assert _records(again.hier) == want
        m, p = again.metadata.first(), part.metadata.first()
        kinds = [k for k, *_ in want]
        assert m.num_scopes == p.num_scopes == kinds.count("scope") and m.num_vars == p.num_vars == kinds.count("var") == count
        assert (m.num_aliases, m.max_handle) == (p.num_aliases, p.max_handle) == (count - p.max_handle, part.vars.select("handle").distinct().count())
        assert [r.alias_of for r in T.variables(again.vars).where("name = 'a5'").collect()] == (["a0"] if count > 2 else [])


def test_broken(tmp_path):
    path = tmp_path / "t"
    for raw in (b"", b"nothing", bytes([B.WRAPPER]) + bytes(16)):
        path.write_bytes(raw)
        with path.open("rb") as f, pytest.raises(B.FormatError):
            B.File(f)
    with pytest.raises(B.FormatError):
        list(B.file_bytes({}, _hier(), [(5, 1, b"0"), (4, 1, b"1")]))
    with pytest.raises(B.FormatError):
        list(B.file_bytes({}, _hier(), [(5, 2, b"0")]))


def test_codecs():
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert B.varint(B.put_varint(n), 0)[0] == n
        for s in (n, -n):
            assert B.signed_varint(B.put_signed_varint(s), 0)[0] == s
    assert B.fastlz(bytes([2]) + b"abc" + bytes([1 << 5, 2]), 6) == b"abcabc"  # a copy of three from three back
    assert B.fastlz(bytes([2 | 32]) + b"abc" + bytes([7 << 5, 255, 1, 2]), 3 + 265) == (b"abc" * 90)[:268]  # level 2: a long one
    with pytest.raises(B.FormatError):
        B.fastlz(bytes([0]) + b"a" + bytes([1 << 5, 9]), 4)

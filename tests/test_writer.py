"""The live writer: blocks that can be read while it runs, flushes, the first time, limits, repacking."""

import struct

import pytest

from tracemill.sources import blocks as B
from tracemill.sources.records import Records
from tracemill.sources.waveform import read_trace
from tracemill.sources.writer import LimitError, LiveWriter


def _records():
    r = Records()
    r.scope("top")
    for kind, name, length in ((16, "clk", 1), (5, "data", 40), (3, "r", 8), (21, "s", 0)):
        r.variable(kind, name, length)
    r.upscope()
    return r


def _blocks(path):
    with open(path, "rb") as f:
        file = B.File(f)
        return file, [[x[:2] + (x[4],) for x in B.block_changes(file, i, None, False)] for i in range(len(file.values))]


@pytest.mark.parametrize("repack", [False, True])
def test_live_writer(spark, tmp_path, repack):
    path = str(tmp_path / "w.trace")
    w = LiveWriter(path, _records(), {"timescale_exp": -12}, block_changes=50)
    want = []
    with pytest.raises(B.FormatError):
        _blocks(path)  # nothing is finished yet
    for t in range(5, 105):
        w.time(t)
        for h, v, raw in ((1, "1" if t % 2 else "0", None), (2, t * 7919, f"{t * 7919:040b}".encode()), (3, t / 3, struct.pack("<d", t / 3)), (4, f"é{t}", None)):
            w.value(h, v)
            want.append((t, h, raw or v.encode()))
        if t in (20, 60):
            w.record(t != 20)
            w.record(t != 20)
    file, got = _blocks(path)
    assert len(got) > 5 and sum(map(len, got)) < len(want) and file.head["start_time"] == 5
    w.value(2, [5, 1])
    want.append((104, 2, f"{(1 << 32) + 5:040b}".encode()))
    w.close(repack)
    w.close()
    trace = read_trace(spark, path)
    assert sorted((r.time, r.handle, bytes(r.raw)) for r in trace.changes.collect()) == sorted(want)
    m = trace.metadata.first()
    assert (m.start_time, m.end_time, m.timescale_exp, m.num_vars, m.num_scopes) == (5, 104, -12, 4, 1)
    assert [(r.time, r.active) for r in trace.blackouts.collect()] == [(20, False), (60, True)]
    with pytest.raises(ValueError, match="closed"):
        w.time(200)


def test_first_time_flush_and_limit(tmp_path):
    path = str(tmp_path / "w.trace")
    with LiveWriter(path, _records()) as w:
        w.value(1, "0")  # before any time: the trace begins at 0
        w.time(7)
        w.flush()
        w.value(1, "1")
        w.time(7)  # the same time: not yet
        assert w.count == 0
        w.time(9)
        assert w.count == 1
        with pytest.raises(B.FormatError):
            w.time(8)
        with pytest.raises(B.FormatError):
            w.value(2, "1")
    file, got = _blocks(path)
    assert file.head["start_time"] == 0 and got == [[(0, 1, b"0"), (7, 1, b"1")]]
    w = LiveWriter(path, _records(), block_changes=1, size_limit=300)
    with pytest.raises(LimitError):
        for t in range(1000):
            w.time(t)
            w.value(1, "01"[t % 2])
    w.close()
    file, got = _blocks(path)
    assert 300 <= sum(b.length for b in file.values) < 900 and [x[0] for b in got for x in b] == list(range(sum(map(len, got))))
    LiveWriter(path, _records()).close()
    assert _blocks(path)[1] == [[]]

"""Trace files as a Spark data source: spark.read.format("waveform").option("table", ...).load(path).

table is one of metadata, hier, changes, blackouts. changes has a partition for each block of values, which carries the
block's place. Options signals (a regular expression on paths), start and end restrict the scan and prune blocks and
chains; a skipped block before start makes the first one read show its frame. Filters on time and handle prune as well with
option pushdown. A file in a gzip wrapper can only be read from its beginning, so all its blocks are one partition. Paths
are ones that all executors can open.
"""

from __future__ import annotations

import gzip
import os
import re
import shutil
import struct
from collections.abc import Callable, Container, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.trace import Trace, TraceError
from . import blocks as B
from .scratch import shared_dir

SCHEMAS = {
    "metadata": "date string, version string, file_type int, timescale_exp int, timezero long, start_time long, end_time long, num_scopes long, num_vars long, num_aliases long, max_handle long, vc_sections long, writer_mem long, endian_match boolean",
    "hier": "ord long, kind string, type_code int, subtype_code int, name string, component string, direction_code int, length int, handle int, is_alias boolean, arg long, arg_from_name long, depth int, path string",
    "changes": "time long, handle int, seq long, value string, raw binary, real_value double, var_len boolean, is_initial boolean, block int",
    "blackouts": "idx int, time long, active boolean",
}


def open_file(path: str) -> B.File:
    """A file, with the hierarchy in <path>.hier if it has none inside; it stays open while its blocks, records and toggles are read."""
    path = path.removeprefix("file:")

    def side() -> bytes | None:
        if not os.path.exists(f"{path}.hier"):
            return None
        with open(f"{path}.hier", "rb") as f:
            return f.read()

    f = open(path, "rb")  # noqa: SIM115
    try:
        return B.File(f, side)
    except BaseException:
        f.close()
        raise


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
_BATCH_ROWS = 8192


class _Blocks(InputPartition):
    """Blocks by number, each with whether its frame comes first; where: what a task needs to read them without the rest of the file."""

    def __init__(self, blocks: list[tuple[int, bool | None, B.Block]], wanted: Container[int] | None, where: tuple | None):
        self.blocks, self.wanted, self.where = blocks, wanted, where


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.table = path, options.get("table", "changes")
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))
        self.signals, self.low, self.high, self.handles = options.get("signals"), None, None, None

    def partitions(self) -> list[InputPartition]:
        if self.table != "changes":
            return [_Blocks([], None, None)]
        file = open_file(self.path)
        wanted: Container[int] | None = self.handles
        if self.signals is not None:
            shown = re.compile(self.signals).search
            found = (r[8] for r in B.hierarchy_records(file.hierarchy) if r[1] == "var" and shown(r[13]))
            wanted = B.Handles(found if wanted is None else (h for h in found if h in wanted))
        file.f.close()
        out, skipped, first = [], False, True
        for i, b in enumerate(file.values):
            if self.start is not None and b.end < self.start:
                skipped = True
                continue
            if self.end is not None and b.begin > self.end:
                break
            frame = (True if skipped else None) if first else False
            first = False
            if (self.low is None or b.end >= self.low) and (self.high is None or b.begin <= self.high):
                out.append((i, frame, b))
        if file.wrapped:
            return [_Blocks(out, wanted, None)] if out else []
        where = (file.geometry, file.head["endian_match"]) if file.geometry else None
        return [_Blocks([x], wanted, where) for x in out]

    def _rows(self, partition: _Blocks) -> Iterator[tuple]:
        if self.table == "changes":
            if partition.where is not None:
                (at, length), match = partition.where
                f = open(self.path.removeprefix("file:"), "rb")  # noqa: SIM115
                f.seek(at)
                file: B.File | B.Part = B.Part(f, {i: b for i, _, b in partition.blocks}, B.widths(f.read(length)), {"endian_match": match})
            else:
                file = open_file(self.path)
            try:
                for number, frame, _ in partition.blocks:
                    yield from B.block_changes(file, number, partition.wanted, frame)
            finally:
                file.f.close()
            return
        file = open_file(self.path)
        try:
            if self.table == "metadata":
                yield tuple(file.head[x.split()[0]] for x in SCHEMAS["metadata"].split(", "))
            else:
                yield from B.hierarchy_records(file.hierarchy) if self.table == "hier" else file.toggles()
        finally:
            file.f.close()

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in SCHEMAS[self.table].split(", ")]
        rows = self._rows(partition)
        while some := list(islice(rows, _BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on time and lists of handles are noted; all filters are applied again above, so a block too many does no harm."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if self.table == "changes" and name == ("time",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low if self.low is not None else f.value, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high if self.high is not None else f.value, f.value)
            if self.table == "changes" and name == ("handle",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.handles = own if self.handles is None else self.handles & own
            yield f


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "changes")]

    def reader(self, schema) -> DataSourceReader:
        # Spark refuses a reader that takes filters while the session does not push them
        kind = _PruningReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], dict(self.options))


def read_trace(spark: SparkSession, path: str, **options: str) -> Trace:
    """The four tables of a file; options (signals, start, end) restrict the changes, and prune blocks and chains.

    Filters prune too where the session has spark.sql.python.filterPushdown.enabled. It is off unless set: Spark keeps what
    one query pushed for the next one of the same DataFrame, so each query then needs a trace read for itself.
    """
    spark.dataSource.register(WaveformSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    load = lambda t, **o: spark.read.format("waveform").options(table=t, pushdown=push, **o).load(path)
    return Trace(load("metadata"), load("hier"), load("changes", **options), load("blackouts"))


#: A block has at least a change for so many signals, as each block shows the state of all of them.
SIGNALS_A_CHANGE = 4
#: Bytes of states that a task makes at once, about.
_STATES = 8_000_000
#: A hierarchy of more bytes is written as gzip members, which tasks make.
_WHOLE = 16_000_000
_SLICE = 50_000


def _put(path: str, parts: Iterable[bytes]) -> int:
    """A file that is there as a whole or not at all; its size."""
    own = f"{path}.{os.urandom(8).hex()}"
    with open(own, "wb") as f:
        size = sum(map(f.write, parts))
    os.replace(own, path)
    return size


_RECORDS = "task int, size long, widths binary, scopes long, variables long, handles long"


def _packed(pieces: str) -> Callable:
    """Records in order -> a file of a task's records, gzipped, and what they count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size, widths, counts = TaskContext.get().partitionId(), 0, bytearray(), np.zeros(3, np.int64)
        own = f"{pieces}/{os.urandom(8).hex()}"
        with gzip.GzipFile(own, "wb", 6, mtime=0) as f:
            for batch in batches:
                for at in range(0, len(batch), _SLICE):
                    rows = batch.slice(at, _SLICE).to_pylist()
                    size += f.write(B.hierarchy_bytes(rows))
                    held = B.widths_of(rows)
                    widths += b"".join(map(B.put_varint, held))
                    counts += [sum(r["kind"] == "scope" for r in rows), sum(r["kind"] == "var" for r in rows), len(held)]
        os.replace(own, f"{pieces}/records-{task}")
        yield _rows_of(_RECORDS, [(task, size, bytes(widths), *counts.tolist())])

    return run


_TOGGLES = "task int, count long, size long, first long, active boolean, last long"


def _toggled(pieces: str) -> Callable:
    """Toggles in order -> a file of all but the first of a task, and that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, first, last = TaskContext.get().partitionId(), 0, None, 0

        def parts() -> Iterator[bytes]:
            nonlocal count, first, last
            for batch in batches:
                toggles = list(zip(batch["time"].to_pylist(), batch["active"].to_pylist(), strict=True))
                if not toggles:
                    continue
                count += len(toggles)
                if first is None:
                    first, last, toggles = toggles[0], toggles[0][0], toggles[1:]
                yield b"".join(B.toggle_steps(toggles, last))
                last = toggles[-1][0] if toggles else last

        size = _put(f"{pieces}/toggles-{task}", parts())
        if first is not None:
            yield _rows_of(_TOGGLES, [(task, count, size, *first, last)])

    return run


def _rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


@lru_cache(1)
def _widths(pieces: str, count: int) -> list[int]:
    with open(f"{pieces}/widths", "rb") as f:
        return B.unpacked_widths(f.read(), count)


_STATE = "at int, range int, content binary"


def _states(pieces: str, signals: int, size: int, numbers: list[int]) -> Callable:
    """The last values of a range of signals in each block -> the range's state before each block but the first."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows["range"][0].as_py()
        low = n * size + 1
        own = _widths(pieces, signals)[low - 1 : low - 1 + size]
        frame = B.first_frame(own)
        rows = rows.sort_by("block")
        edge = np.searchsorted(rows["block"].to_numpy(), numbers, "right").tolist()
        content, at = [], 0
        for to in edge[:-1]:
            some = rows.slice(at, to - at)
            for h, v in zip(some["handle"].to_pylist(), some["value"].to_pylist(), strict=True):
                if own[h - low] != B.TEXT_LENGTH:
                    frame[h - low] = v
            content.append(b"".join(frame))
            at = to
        return pa.table({"at": pa.array(numbers[1:], pa.int32()), "range": pa.array([n] * len(content), pa.int32()), "content": pa.array(content, pa.binary())})

    return run


_BUILT = "block int, size long"


def _built(pieces: str, signals: int, size: int, spans: dict[int, tuple[int, int]], kind: str) -> Callable:
    """The changes of a block, and the state before it by ranges of signals -> a file of the block."""

    def run(changes: pa.Table, states: pa.Table) -> pa.Table:
        number, widths = changes["block"][0].as_py(), _widths(pieces, signals)
        shown = dict(zip(states["range"].to_pylist(), states["content"], strict=True))
        state = b"".join([shown[r].as_py() if r in shown else b"".join(B.first_frame(widths[r * size : (r + 1) * size])) for r in range(-(-signals // size))])
        own = changes.sort_by([("handle", "ascending"), ("time", "ascending"), ("seq", "ascending")])
        begin, end = spans[number]
        times, steps = np.unique(np.concatenate([own["time"].to_numpy(), [begin, end]]), return_inverse=True)

        def rows() -> Iterator[tuple[int, int, bytes]]:
            for at in range(0, len(own), _SLICE):
                some = own.slice(at, _SLICE)
                yield from zip(some["handle"].to_pylist(), steps[at : at + len(some)].tolist(), some["value"].to_pylist(), strict=True)

        content = B.assembled(begin, end, times.tolist(), B.chains(rows(), widths), state, signals, kind)
        return pa.Table.from_batches([_rows_of(_BUILT, [(number, _put(f"{pieces}/block-{number}", [content]))])])

    return run


def write_trace(trace: Trace, path: str, kind: str = "4", block_changes: int = 1_000_000) -> None:
    """One file of a trace: tasks build blocks of about so many changes, records and toggles as files, the driver puts these one after the other.

    kind: 4 (LZ4) or Z (zlib). Values come from raw where it is not null, else from value, in UTF-8. Blocks are ranges of
    time, so all changes of one time are in one block. Each block also shows the state of all signals before it, so there
    is no more than one for every quarter as many changes as signals: the states of a file are then no more than four times
    the signals that its changes name. The driver keeps a pair of times for each block and the widths, a byte or more for
    each signal. A hierarchy of up to 16 MB is one LZ4 block, a larger one gzip members.
    """
    spark = trace.changes.sparkSession
    folder = f"{shared_dir(spark)}/{os.urandom(16).hex()}"
    # files that tasks write and the driver reads: in the shared folder, or beside the path if that folder is no place to open files
    pieces = f"{folder.removeprefix('file:')}/pieces" if "://" not in folder.removeprefix("file:") else f"{os.path.abspath(path)}.pieces-{os.urandom(8).hex()}"
    os.makedirs(pieces)
    try:
        _write(trace, path, kind, block_changes, folder, pieces)
    finally:
        _widths.cache_clear()
        shutil.rmtree(pieces, ignore_errors=True)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _write(trace: Trace, path: str, kind: str, block_changes: int, folder: str, pieces: str) -> None:
    spark = trace.changes.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        """df, made once and read again from a file."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    meta = trace.metadata.select([c for c in ("date", "version", "file_type", "timescale_exp", "timezero", "start_time", "end_time") if c in trace.metadata.columns]).first().asDict()
    hier = trace.hier.select([F.col(n).cast(k) for n, k in (x.split() for x in SCHEMAS["hier"].split(", ")) if n in trace.hier.columns])
    records = sorted(kept(hier, "records").orderBy("ord").mapInArrow(_packed(pieces), _RECORDS).collect(), key=lambda r: r.task)
    toggles = sorted(kept(trace.blackouts.select("idx", "time", "active"), "toggles").orderBy("idx").mapInArrow(_toggled(pieces), _TOGGLES).collect(), key=lambda r: r.task)
    signals, raw = sum(r["handles"] for r in records), b"".join(r["widths"] for r in records)
    _put(f"{pieces}/widths", [raw])
    value = F.col("value").cast("binary")
    value = F.coalesce(F.col("raw"), value) if "raw" in trace.changes.columns else value
    own = kept(trace.changes.select("time", "handle", "seq", value.alias("value")), "changes")
    bad = (F.col("handle") < 1) | (F.col("handle") > signals) | F.col("handle").isNull() | F.col("time").isNull() | F.col("value").isNull()
    known = own.agg(F.count("*").alias("count"), F.count_if(bad).alias("bad"), F.min("time").alias("first")).first()
    if known["bad"]:
        raise TraceError("a change without time or value, or of a handle that no variable has")
    blocks = max(1, -(-known["count"] // max(block_changes, signals // SIGNALS_A_CHANGE)))
    cuts = own.agg(F.percentile_approx("time", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def block(time: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, time.to_numpy()).astype(np.int32))

    own = own.withColumn("block", block("time"))
    last = own.groupBy("block").agg(F.max("time").alias("last")).orderBy("block").collect()
    start = meta["start_time"] if meta.get("start_time") is not None else known["first"] or 0
    end = max(meta.get("end_time") or 0, last[-1]["last"] if last else start, start)
    begins = [start, *(r["last"] for r in last)]
    spans = {r.block: (a, b) for r, a, b in zip(last, begins, [*begins[1 : len(last)], end], strict=False)}
    # the last value of each handle in each block, carried on by ranges of handles: the state before the later blocks
    shown = sum(0 if w == B.TEXT_LENGTH else w or 8 for w in _widths(pieces, signals))
    size = max(1, signals // max(1, len(last) * (shown + 16 * signals) // _STATES))
    state = own.groupBy("block", "handle").agg(F.max_by("value", F.struct("time", "seq")).alias("value"))
    state = state.withColumn("range", F.floor((F.col("handle") - 1) / size).cast("int")).groupBy("range").applyInArrow(_states(pieces, signals, size, [r.block for r in last]), _STATE)
    built = own.groupBy("block").cogroup(state.groupBy("at")).applyInArrow(_built(pieces, signals, size, spans, kind), _BUILT)
    if last:
        built.agg(F.sum("size")).collect()
    with open(f"{path}.part", "wb") as f:

        def add(name: str) -> None:
            with open(f"{pieces}/{name}", "rb") as piece:
                shutil.copyfileobj(piece, f, 1 << 20)

        f.write(B.counted_header(meta, sum(r["scopes"] for r in records), sum(r["variables"] for r in records), signals, start, end, max(1, len(last))))
        if not last:
            f.write(B.assembled(start, end, sorted({start, end}), [], b"".join(B.first_frame(_widths(pieces, signals))), signals, kind))
        for r in last:
            add(f"block-{r.block}")
        f.write(B.geometry_block(raw, signals))
        if toggles:
            firsts = [next(B.toggle_steps([(r["first"], r["active"])], before)) for r, before in zip(toggles, [0, *(r["last"] for r in toggles)], strict=False)]
            total = B.put_varint(sum(r["count"] for r in toggles))
            f.write(B.block_start(B.BLACKOUT, len(total) + sum(map(len, firsts)) + sum(r["size"] for r in toggles)) + total)
            for r, x in zip(toggles, firsts, strict=True):
                f.write(x)
                add(f"toggles-{r.task}")
        names, whole = [f"records-{r.task}" for r in records], sum(r["size"] for r in records)
        if kind == "4" and whole <= _WHOLE:
            f.write(B.hierarchy_block(b"".join(gzip.open(f"{pieces}/{n}").read() for n in names), kind))
        else:
            f.write(B.block_start(B.HIERARCHY, 8 + sum(os.path.getsize(f"{pieces}/{n}") for n in names)) + struct.pack(">Q", whole))
            for n in names:
                add(n)
    os.replace(f"{path}.part", path)


def write_vcd(lines: DataFrame, path: str) -> None:
    """Lines (time, ord, line) in order, as one text."""
    with open(path, "w", encoding="utf-8") as f:
        for r in lines.orderBy("time", "ord").select("line").toLocalIterator(prefetchPartitions=True):
            f.write(r.line + "\n")

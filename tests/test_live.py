"""A file that grows between micro-batches, and the state per signal."""

from tracemill.sources import blocks as B
from tracemill.streaming.live import last_values, read_growing, write_changes

HIER = [{"kind": "var", "type_code": 16, "direction_code": 0, "name": n, "length": 4, "handle": i, "is_alias": False} for i, n in enumerate("ab", 1)]


def _write(path, times):
    rows = [(t, h, format(t % 16, "04b").encode()) for t in times for h in ((1, 2) if t % 2 else (1,))]
    with open(path, "wb") as f:
        f.writelines(B.file_bytes({"start_time": 0}, HIER, rows, (), "4", 8))


def test_growing_file(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    for last in (10, 40):
        _write(path, range(1, last))
        query = write_changes(read_growing(spark, path), out, str(tmp_path / "c"))
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(out).where("not is_initial").select("time", "handle").distinct()
    assert got.where("time between 12 and 39").count() == 28 + 14


def test_last_values(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(t, 1 + t % 3, t, str(t)) for t in range(30)]
    schema = "time long, handle int, seq long, value string"
    spark.createDataFrame(rows[:20], schema).write.parquet(path)
    sink = []

    def keep(df, _):
        sink.extend(tuple(r) for r in df.collect())

    for part in (None, rows[20:]):
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        last_values(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(120)
    assert {h: (t, v) for h, t, v in sink} == {1: (27, "27"), 2: (28, "28"), 3: (29, "29")}
    assert len(sink) == 6

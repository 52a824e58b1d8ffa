"""Live traces: a file that is still being written as a stream, value changes to Parquet, and the state per signal.

A finished block of a growing file is an offset. The producer keeps times in order; a signal's changes that come after a
later one of the same signal are an error of the producer, and the state keeps the later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import blocks as B
from ..sources.waveform import SCHEMAS, open_file


class _Growing(DataSourceStreamReader):
    """Offsets count finished blocks; each new one is a partition."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"blocks": 0}

    def latestOffset(self) -> dict:
        try:
            return {"blocks": len(open_file(self.path).values)}
        except (B.FormatError, FileNotFoundError):  # nothing is finished yet
            return {"blocks": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(i) for i in range(start["blocks"], end["blocks"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from B.block_changes(open_file(self.path), partition.value, None, False if partition.value else None)


class GrowingSource(DataSource):
    """spark.readStream.format("waveform_live").load(path): the changes of each block as soon as it is finished."""

    @classmethod
    def name(cls) -> str:
        return "waveform_live"

    def schema(self) -> str:
        return SCHEMAS["changes"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(self.options["path"])


def read_growing(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GrowingSource)
    return spark.readStream.format("waveform_live").load(path)


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """Appends a stream of changes as Parquet, a file set for each micro-batch; ends when what is there is written."""
    return changes.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def last_values(changes: DataFrame) -> DataFrame:
    """handle, time, value: after each micro-batch the newest value of each signal that changed in it. One small state per signal."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for frame in frames:
            top = frame.sort_values(["time", "seq"]).iloc[-1]
            got = (int(top["time"]), int(top["seq"]), top["value"])
            if best is None or got[:2] >= tuple(best)[:2]:
                best = got
        state.update(tuple(best))
        yield pd.DataFrame({"handle": [key[0]], "time": [best[0]], "value": [best[2]]})

    own = changes.select("handle", "time", "seq", "value")
    return own.groupBy("handle").applyInPandasWithState(step, "handle int, time long, value string", "time long, seq long, value string", "update", GroupStateTimeout.NoTimeout)

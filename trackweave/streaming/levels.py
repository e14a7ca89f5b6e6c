"""In-flight level and its high-water marks on a stream of deliveries.

The batch operator's two steps, in state. A start counts at `submit_ts`, an end at `done_ts`, in the interval that it falls
into, each interval under a key of its own; an end that is known early waits there. The watermark is that of `submit_ts`: when it passes
an interval's end, all that changes it is known, as no message ends before it starts, and the interval is closed: its net change and the
highest point of its own running sum. Closed intervals, few rows, come to one key that holds the level and the marks so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..options import TrackOptions
from . import packed

_CLOSED = "interval_ms long, d long, c long, d_hi long, c_hi long"
_LEVELS = "interval_ms long, occ long, occ_hi_this long, chunks long, chunks_hi_this long, occ_hi long, chunks_hi long"


def _by_instant(steps: np.ndarray) -> np.ndarray:
    """Changes (at, d, c) in order, those of one instant and direction added up; at one instant ends come before starts."""
    rising = steps[:, 1] > 0
    order = np.lexsort((rising, steps[:, 0]))
    steps, rising = steps[order], rising[order]
    new = np.append(True, (steps[1:, 0] != steps[:-1, 0]) | (rising[1:] != rising[:-1]))
    starts = np.flatnonzero(new)
    return np.column_stack([steps[starts, 0], np.add.reduceat(steps[:, 1:], starts)])


class _Interval(StatefulProcessor):
    """Changes of one interval: a batch adds one cell of them to its state, whatever their number."""

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", packed.PACKED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = np.concatenate([frame[["at", "d", "c"]].to_numpy(np.int64) for frame in rows])
        self.steps.appendValue((packed.pack(_by_instant(fresh)),))
        self.handle.registerTimer(int(key[0]) + self.width_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.steps.exists():
            return
        steps = _by_instant(packed.unpack((r[0] for r in self.steps.get()), 3))
        self.steps.clear()
        level = np.cumsum(steps[:, 1:], axis=0)
        (d, c), (d_hi, c_hi) = level[-1], level.max(axis=0)
        yield pd.DataFrame({"interval_ms": [int(key[0])], "d": [d], "c": [c], "d_hi": [d_hi], "c_hi": [c_hi]})

    def close(self) -> None:
        pass


class _Level(StatefulProcessor):
    """Closed intervals in order, from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "occ long, chunks long, occ_hi long, chunks_hi long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        occ, chunks, occ_hi, chunks_hi = self.now.get() if self.now.exists() else (0, 0, 0, 0)
        for r in sorted(rows, key=lambda r: r.interval_ms):
            this, chunks_this = max(occ, occ + r.d_hi), max(chunks, chunks + r.c_hi)
            occ, chunks = occ + r.d, chunks + r.c
            occ_hi, chunks_hi = max(occ_hi, this), max(chunks_hi, chunks_this)
            yield Row(interval_ms=r.interval_ms, occ=occ, occ_hi_this=this, chunks=chunks, chunks_hi_this=chunks_this, occ_hi=occ_hi, chunks_hi=chunks_hi)
        self.now.update((occ, chunks, occ_hi, chunks_hi))

    def close(self) -> None:
        pass


def occupancy_stream(delivery: DataFrame, options: TrackOptions = TrackOptions(), delay: str = "10 seconds") -> DataFrame:
    """Per closed interval what `occupancy` gives; rows behind the watermark of `submit_ts` are dropped, messages without an end stay in flight."""
    width = options.monitor_interval * 1000
    chunks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / options.chunk_size)).cast("long")
    rows = delivery.where("submit_ts is not null").withWatermark("submit_ts", delay)
    changes = F.array(F.struct(F.unix_micros("submit_ts").alias("at"), F.lit(1).alias("change")), F.struct(F.unix_micros("done_ts").alias("at"), F.lit(-1).alias("change")))
    steps = rows.select("submit_ts", F.coalesce(chunks, F.lit(1)).alias("chunks"), F.inline(changes)).where("at is not null")
    steps = steps.withColumn("interval_ms", F.floor(F.col("at") / (width * 1000)).cast("long") * width)
    steps = steps.select("interval_ms", "submit_ts", "at", F.col("change").cast("long").alias("d"), (F.col("change") * F.col("chunks")).alias("c"))
    closed = steps.groupBy("interval_ms").transformWithStateInPandas(_Interval(width), _CLOSED, "append", "eventTime")
    levels = closed.withColumn("all", F.lit(0)).groupBy("all").transformWithState(_Level(), _LEVELS, "append", "none")
    return levels.select(F.timestamp_millis("interval_ms").alias("interval_start"), "occ", "occ_hi_this", "chunks", "chunks_hi_this", "occ_hi", "chunks_hi")

"""Counters of running streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..options import TrackOptions
from ..sources.plugin import folder_of

#: A finished batch of a stream: its run and number, when it was done, what it held, and rows that came too late.
HISTORY = "run string, batch long, at timestamp, messages long, bytes long, len_hi long, late long"


def observe(stream: DataFrame, name: str = "messages") -> DataFrame:
    """Attach per-batch counters to a stream of messages with a `data` column."""
    return stream.observe(name, F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("data")), F.lit(0)).alias("len_hi"))


class History(StreamingQueryListener):
    """Keeps the counters of finished batches and incidents (failures and late rows) for snapshots."""

    def __init__(self, name: str = "messages"):
        self.name, self.rows, self.incidents = name, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None:
            self.rows.append({"batch": p.batchId, "at": p.timestamp, **seen.asDict()})
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if dropped:
            self.incidents.append({"kind": "late", "at": p.timestamp, "detail": str(dropped)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.incidents.append({"kind": "reacquire", "at": None, "detail": event.exception})


class HistoryTable(StreamingQueryListener):
    """Writes the counters of every finished batch to a folder, one small file a batch, so nothing is kept in memory and the history outlives the driver."""

    def __init__(self, path: str, name: str = "messages"):
        self.system, self.root = folder_of(path)
        self.name = name
        self.system.create_dir(self.root, recursive=True)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        row = {"run": str(p.runId), "batch": p.batchId, "at": p.timestamp, **(seen.asDict() if seen is not None else {}), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        with self.system.open_output_stream(f"{self.root}/{p.runId}-{p.batchId}.json") as out:
            out.write(json.dumps(row).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The table that HistoryTable writes, one row a batch."""
    return spark.read.schema(HISTORY).json(path)


def history_snapshots(history: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """Per `monitor_interval`: batches, messages, bytes and late rows, own and so far, and the longest message; from a history."""
    sums = ("messages", "bytes", "late")
    per = history.groupBy(F.window("at", f"{options.monitor_interval} seconds")["start"].alias("interval_start")).agg(
        F.count(F.lit(1)).alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.coalesce(F.max("len_hi"), F.lit(0)).alias("len_hi")
    )
    upto = Window.orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)  # a row per interval
    return per.withColumns({f"total_{c}": F.sum(c).over(upto) for c in sums})

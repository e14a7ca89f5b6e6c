"""Requests of a live log under a timeout and a limit of open requests at once, in order of time.

A shard's rows wait in state by time bucket until the watermark has passed their bucket; then they are
taken in order of time. So what ends, times out or is pushed out does not depend on how the log was cut
into batches, and no batch is ever sorted whole. Rows go into state packed, in cells of a stretch of buckets, which are not opened before their time;
memory holds one stretch, and a bounded number of rows behind it.

Requests time out and are pushed out in the order of their first records, as all have the same timeout. The
oldest is the only one that is looked at; requests that ended meanwhile are passed over when they come to the front.

At one instant timeouts come first: a request whose time is up takes no more records. What comes later forms a
request of its own. Ties are broken by group, then by place in the log.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..options import TrackOptions
from . import cells as C
from . import packed
from .assemble import COMPLETED, RECORD, flat, in_cells, record_struct, shard_column, shard_of, timed
from .open_requests import OpenRequests, chunks

#: Rows that are held on their way to or from their buckets, about.
HELD = 50_000
#: Buckets of a stretch.
STRETCH = 64


class InTimeOrder(StatefulProcessor):
    """Keeps rows by time bucket and hands each bucket on, in order of its columns, once the watermark has passed its end.

    `columns` is DDL of what is kept of a row; the first is the time in ms.
    """

    def __init__(self, bucket_ms: int, columns: str, held: int = HELD):
        self.bucket_ms, self.names, self.held = bucket_ms, [c.split()[0] for c in columns.split(", ")], held
        self.kept = f"rows array<struct<{columns.replace(', ', ',').replace(' ', ':')}>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", self.kept)
        self.pending = handle.getValueState("pending", "ends array<long>")
        self.dealt: dict[Any, int] = {}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, n = {}, 0
        for r in rows:
            row = tuple(r[name] for name in self.names)
            held.setdefault(row[0] // self.bucket_ms, []).append(row)
            n += 1
            if n == self.held:
                self._keep(held)
                held, n = {}, 0
        self._keep(held)
        return iter(())

    def _keep(self, held: dict[int, list[tuple]]) -> None:
        ends = self._ends()
        for bucket, fresh in held.items():
            if self.waiting.containsKey((bucket,)):
                fresh = [tuple(x) for x in self.waiting.getValue((bucket,))[0]] + fresh
            else:
                self.handle.registerTimer(self.end_of(bucket))
                ends.append(self.end_of(bucket))
            self.waiting.updateValue((bucket,), (fresh,))
        if held:
            self.pending.update((sorted(ends),))

    def _ends(self) -> list[int]:
        """The ends of the buckets that wait, in order."""
        return list(self.pending.get()[0]) if self.pending.exists() else []

    def end_of(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_ms

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.dealt.get(key[0]) == mark:
            return  # the first timer of a batch sees to all that the watermark has passed
        self.dealt[key[0]] = mark
        self.key, self.mark = key[0], mark
        ends = self._ends()
        up = [end for end in ends if end <= mark]
        # no timer of this batch comes behind the last bucket that the watermark has passed, so what is up by then is seen to now
        until, rows = max(expiredTimerInfo.getExpiryTimeInMs(), mark // self.bucket_ms * self.bucket_ms, *up[-1:]), []
        for end in up:
            bucket = (end // self.bucket_ms - 1,)
            rows += sorted(tuple(x) for x in self.waiting.getValue(bucket)[0])
            self.waiting.removeKey(bucket)
            if len(rows) >= self.held and end != up[-1]:
                yield from self.take(rows, end)
                rows = []
        if up:
            self.pending.update((ends[len(up):],))
        yield from self.take(rows, until)

    def take(self, rows: list[tuple], until: int) -> Iterator[Row]:
        """The rows of buckets that follow each other, in order, and the time up to which there are no others; also called without rows at times that were registered."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class CellsInTimeOrder(InTimeOrder):
    """The same over cells of records: they wait by stretches of buckets, so state is called for each stretch and not each bucket or row.

    Records of a bucket that was handed on before they came are dropped. What `take` gets is in order of time and group.
    """

    def __init__(self, bucket_ms: int, held: int = HELD):
        super().__init__(bucket_ms, packed.PACKED, held)
        self.kept = "cells array<binary>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passed = handle.getValueState("passed", "at long")  # all before it was handed on

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, n = {}, 0
        for frame in rows:
            for stretch, cell in zip(frame["stretch"].tolist(), frame["packed"].tolist(), strict=True):
                held.setdefault(stretch, []).append(bytes(cell))
                n += C.size(cell)
                if n >= self.held:
                    self._keep(held)
                    held, n = {}, 0
        self._keep(held)
        return iter(())

    def _keep(self, held: dict[int, list[bytes]]) -> None:
        waits = set(known := self._ends())
        for stretch, fresh in held.items():
            if stretch in waits:
                fresh = [*self.waiting.getValue((stretch,))[0], *fresh]
            else:
                known.append(stretch)
                # its buckets are looked at once the watermark has passed the first
                self.handle.registerTimer(stretch * STRETCH * self.bucket_ms + self.bucket_ms)
            self.waiting.updateValue((stretch,), (fresh,))
        if held:
            self.pending.update((sorted(known),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.mark = timerValues.getCurrentWatermarkInMs()
        if self.dealt.get(key[0]) == self.mark:
            return  # the first timer of a batch sees to all that the watermark has passed
        self.dealt[key[0]] = self.mark
        self.key = key[0]
        passed = self.passed.get()[0] if self.passed.exists() else None
        upto = max(self.mark // self.bucket_ms * self.bucket_ms, C.NONE if passed is None else passed)
        known, found, n = self._ends(), [], 0
        left = [stretch for stretch in known if stretch * STRETCH * self.bucket_ms >= upto]
        self.begin()
        for stretch in known[: len(known) - len(left)]:
            records = C.decode(bytes(cell) for cell in self.waiting.getValue((stretch,))[0])
            at = records.rows[:, C.AT]
            rest = records.take(np.flatnonzero(at >= upto))
            if len(rest):
                self.waiting.updateValue((stretch,), ([C.whole(rest)],))
                self.handle.registerTimer(upto + self.bucket_ms)
                left.append(stretch)
            else:
                self.waiting.removeKey((stretch,))
            found.append(records.take(np.flatnonzero((at < upto) & (at >= (C.NONE if passed is None else passed)))))
            n += len(found[-1])
            if n >= self.held:
                yield from self._taken(C.joined(found), min((stretch + 1) * STRETCH * self.bucket_ms, upto))
                found, n = [], 0
        yield from self._taken(C.joined(found), upto)
        self.pending.update((sorted(left),))
        self.passed.update((upto,))
        self.end()

    def _taken(self, records: C.Records, until: int) -> Iterator[pd.DataFrame]:
        records = self.in_order(records)
        bounds = C.starts_of(records.rows[:, C.AT] // self.bucket_ms)
        for start, stop in chunks(bounds, len(records), self.held):
            yield from self.take(records.slice(start, stop), int(records.rows[stop, C.AT]) if stop < len(records) else until)
        if not len(records):
            yield from self.take(records, until)

    def in_order(self, records: C.Records) -> C.Records:
        return records.sorted_by(C.AT, C.GROUP, C.VXID, C.TX, C.REC)

    def begin(self) -> None:
        """Called before what a batch hands on, and `end` behind it."""

    def end(self) -> None: ...


class _Requests(CellsInTimeOrder):
    def __init__(self, bucket_ms: int, timeout: float, limit: int, held: int):
        super().__init__(bucket_ms, held)
        self.timeout_ms, self.limit = int(timeout * 1000), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "group_vxid long", f"first long, {packed.PACKED}")

    def begin(self) -> None:
        self.requests = OpenRequests(self.limit, self.timeout_ms)
        for k, v in self.open.iterator():
            self.requests.load(C.NONE if k[0] is None else k[0], v[0], bytes(v[1]))

    def take(self, records: C.Records, until: int) -> Iterator[pd.DataFrame]:
        self.requests.take(records)
        self.requests.expire(until - 1)
        for reason, cell in self.requests.finish():
            yield pd.DataFrame({"complete_reason": [reason], "packed": [cell]})

    def end(self) -> None:
        for group in self.requests.gone():
            self.open.removeKey((None if group == C.NONE else group,))
        for group, first, cell in self.requests.changed():
            self.open.updateValue((None if group == C.NONE else group,), (first, cell))
            alarm = self.end_of((first + self.timeout_ms) // self.bucket_ms)
            if alarm > self.mark:
                self.handle.registerTimer(alarm)


def _stretches(bucket_ms: int, rows: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return shard_column(batch), rows[:, C.AT] // (bucket_ms * STRETCH)


def track_requests(stream: DataFrame, options: TrackOptions = TrackOptions(), shards: int = 32, bucket: float = 1.0, delay: str = "10 seconds", held: int = HELD) -> DataFrame:
    """Stream of complete requests (group_vxid, complete_reason, records): by 'end', 'timeout' or 'limit'.

    At most `tx_limit` requests are open, shared evenly by `shards` (hash of the group): exact with one, an
    approximation that scales with more. `bucket` is in seconds; a stretch of buckets of a shard is held in memory, and `held` rows
    on their way there. Rows whose bucket was handed on are dropped.
    """
    bucket_ms = int(bucket * 1000)
    rows = in_cells(timed(stream), functools.partial(_stretches, bucket_ms), ["shard", "stretch"], delay, shard_of(shards))
    processor = _Requests(bucket_ms, options.tx_timeout, max(1, options.tx_limit // shards), held)
    found = rows.groupBy("shard").transformWithStateInPandas(processor, C.DONE, "append", "eventTime")
    return found.mapInArrow(C.done_requests, COMPLETED)


class _Placed(CellsInTimeOrder):
    """Numbers a partition's messages as their buckets are handed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "place long")

    def in_order(self, records: C.Records) -> C.Records:
        """In order of time and group, and of texts where there are several."""
        records = records.sorted_by(C.AT, C.GROUP)
        rows = records.rows
        if len(C.starts_of(rows[:, C.AT], rows[:, C.GROUP])) == len(rows):
            return records
        texts = pc.rank(records.texts.cast(pa.binary()), tiebreaker="dense").to_numpy()
        return records.take(np.lexsort([texts, rows[:, C.GROUP], rows[:, C.AT]]))

    def take(self, records: C.Records, until: int) -> Iterator[pd.DataFrame]:
        if not len(records):
            return
        place = self.last.get()[0] if self.last.exists() else 0
        rows = records.rows.copy()
        rows[:, C.AT] = np.arange(place + 1, place + 1 + len(rows))
        self.last.update((place + len(rows),))
        yield pd.DataFrame({"partition": [self.key], "packed": [C.whole(C.Records(rows, records.texts))]})


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition and messages of cells, a row each. A key and its value are one text, with the key's length in the place of a vxid."""
    for batch in batches:
        for partition, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            records = C.decode([cell])
            rows, n = records.rows, len(records)
            both = np.column_stack([rows[:, C.VXID], rows[:, C.SIZE] - rows[:, C.VXID]]).reshape(-1)
            offsets = np.append(0, np.cumsum(both)).astype(np.int32)
            texts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(offsets), records.texts.buffers()[2])
            text = lambda i, null, texts=texts, rows=rows, n=n: pc.if_else(pa.array(rows[:, null] == 1), pa.scalar(None, pa.string()), texts.take(pa.array(np.arange(i, 2 * n, 2))))
            group = pa.array(rows[:, C.GROUP], pa.int64(), mask=rows[:, C.GROUP] == C.NONE)
            yield pa.RecordBatch.from_arrays([pa.array([partition] * n, pa.int32()), pa.array(rows[:, C.AT]), group, text(0, C.TX), text(1, C.REC)], names=["partition", "place", "group_vxid", "key", "value"])


def ordered_stream(routed: DataFrame, at: str = "ts", bucket: float = 1.0, delay: str = "10 seconds") -> DataFrame:
    """A stream of routed messages in sink order: partition, place (from 1), group_vxid, key, value.

    Messages wait until the watermark has passed their bucket of `bucket` seconds, and then go in order of time and group. Those whose bucket
    was handed on are dropped. A partition of the sink is in one task, as it has one order.
    """
    bucket_ms = int(bucket * 1000)
    key, value = F.coalesce("key", F.lit("")), F.coalesce("value", F.lit(""))
    rows = routed.where(F.col(at).isNotNull() & F.col("partition").isNotNull()).select(
        "group_vxid",
        F.unix_millis(at).alias("at_ms"),
        F.octet_length(key).cast("long").alias("vxid"),
        F.col("key").isNull().cast("int").alias("tx_seq"),
        F.col("value").isNull().cast("int").alias("rec_seq"),
        F.lit(C.TAGS[0]).alias("tag"),
        F.concat(key, value).alias("payload"),
        "partition",
    )
    cells = in_cells(rows, functools.partial(_stretches, bucket_ms), ["partition", "stretch"], delay, F.col("partition"))
    found = cells.groupBy("partition").transformWithStateInPandas(_Placed(bucket_ms), f"partition int, {packed.PACKED}", "append", "eventTime")
    return found.mapInArrow(_messages, "partition int, place long, group_vxid long, key string, value string")


def drain_tracked(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream of track_requests still holds: records of open requests and those that wait for their bucket, by group, reason 'drain'."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    waiting = read("waiting").select(F.explode("user_map_value.cells").alias("packed"))
    records = flat(read("open").select("user_map_value.packed").unionByName(waiting))
    return record_struct(records.select("group_vxid", F.struct(*[c.split()[0] for c in RECORD.split(", ")]).alias("record")))

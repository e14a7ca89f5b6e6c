"""Assembly of a live log: open requests are kept as state until they end, time out or are pushed out.

The stream carries `End` records, one per transaction. A request is complete when its root's `End`
has come and every subrequest seen so far has ended. It is forced out `tx_timeout` seconds after its
first record, by event time; what comes later forms a request of its own. Stored records are put
through the batch operators' rules by `assemble_open` and `rules`.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.assemble import group_state
from ..operators.filters import client_requests
from ..options import TrackOptions
from . import cells as C
from . import packed
from .open_requests import OpenRequests, chunks

RECORD = "vxid long, tx_type string, side string, tx_seq int, rec_seq int, tag string, payload string"
RECORDS = f"records array<struct<{RECORD.replace(' long', ':long').replace(' string', ':string').replace(' int', ':int')}>>"
COMPLETED = f"group_vxid long, complete_reason string, {RECORDS}"
_NAMES = [field.split()[0] for field in RECORD.split(", ")]


class _Requests(StatefulProcessor):
    """The requests of a block of ids. A batch reads and writes the state of a block at once, not of each of its requests."""

    def __init__(self, timeout: float):
        self.timeout_ms = int(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("recs", packed.PACKED)
        self.deadline = handle.getValueState("deadline", packed.PACKED)  # of each open request: group, deadline, when it is seen to
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = C.decode(bytes(cell) for frame in rows for cell in frame["packed"])
        due, held, both = self._due(), C.empty(), fresh
        if np.isin(fresh.rows[:, C.GROUP], due[:, 0]).any():
            held = self._held()
            known = np.isin(held.rows[:, C.GROUP], fresh.rows[:, C.GROUP])
            both, held = C.joined([held.take(np.flatnonzero(known)), fresh]), held.take(np.flatnonzero(~known))
        both = both.sorted_by(C.GROUP, C.TX, C.REC)
        starts = C.starts_of(both.rows[:, C.GROUP])
        done, groups = C.complete(both.rows, starts), both.rows[starts, C.GROUP]
        ended = np.repeat(done, np.diff(np.append(starts, len(both))))
        gone = np.isin(due[:, 0], groups[done])
        if gone.any():
            self._write(C.joined([held, both.take(np.flatnonzero(~ended))]))
        elif not done.all():
            opened = fresh.take(np.flatnonzero(~np.isin(fresh.rows[:, C.GROUP], groups[done])))
            self.records.appendValue((C.whole(opened.sorted_by(C.GROUP, C.TX, C.REC)),))
        new = ~done & ~np.isin(groups, due[:, 0])
        at = np.minimum.reduceat(both.rows[:, C.AT], starts)[new] + self.timeout_ms
        soonest = np.maximum(at, timerValues.getCurrentWatermarkInMs() + 1)
        if gone.any() or new.any():
            self._set_due(np.concatenate([due[~gone], np.column_stack([groups[new], at, soonest])]))
        if new.any():
            self._wake(int(soonest.min()))
        yield from self._emit("end", both.take(np.flatnonzero(ended)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(at, timerValues.getCurrentWatermarkInMs())
        if not self.timer.exists() or self.timer.get()[0] != at:
            return
        self.timer.clear()
        due = self._due()
        up = due[:, 2] <= now
        if up.any():
            held = self._held()
            gone = np.isin(held.rows[:, C.GROUP], due[up, 0])
            self._write(held.take(np.flatnonzero(~gone)))
            due = due[~up]
            self._set_due(due)
            yield from self._emit("timeout", held.take(np.flatnonzero(gone)).sorted_by(C.GROUP, C.TX, C.REC))
        if len(due):
            self._wake(int(due[:, 2].min()))

    def _held(self) -> C.Records:
        return C.decode(bytes(row[0]) for row in self.records.get())

    def _write(self, records: C.Records) -> None:
        if len(records):
            self.records.put([(C.whole(records),)])
        else:
            self.records.clear()

    def _due(self) -> np.ndarray:
        return packed.unpack(self.deadline.get() if self.deadline.exists() else (), 3)

    def _set_due(self, due: np.ndarray) -> None:
        if len(due):
            self.deadline.update((packed.pack(due),))
        else:
            self.deadline.clear()

    def _wake(self, at: int) -> None:
        """Have a timer at the soonest deadline of the block, and no other."""
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def _emit(self, reason: str, done: C.Records) -> Iterator[pd.DataFrame]:
        if len(done):
            yield pd.DataFrame({"complete_reason": [reason], "packed": [C.whole(C.numbered(done, C.starts_of(done.rows[:, C.GROUP])))]})

    def close(self) -> None:
        pass


class _Limited(StatefulProcessor):
    """Open requests per shard; the oldest leave when there are more than `limit`. A batch reads what is open once, and writes the requests it touched."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "group_vxid long", "at long")
        self.open = handle.getMapState("open", "group_vxid long", "packed string")  # a cell, as text

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = C.decode(bytes(cell) for frame in rows for cell in frame["packed"])
        cells = {k[0]: base64.b64decode(v[0]) for k, v in self.open.iterator()}
        requests = OpenRequests(self.limit, None)
        for k, v in self.first.iterator():
            requests.load(C.NONE if k[0] is None else k[0], v[0], cells[k[0]])
        came = came.take(np.argsort(came.rows[:, C.AT], kind="stable"))
        bounds = C.starts_of(came.rows[:, C.AT] // 1000)  # requests are not cut where it can be helped
        for start, stop in chunks(bounds, len(came)):
            requests.take(came.slice(start, stop))
            for reason, cell in requests.finish():
                yield pd.DataFrame({"complete_reason": [reason], "packed": [cell]})
        for group in requests.gone():
            self.first.removeKey((_id(group),))
            self.open.removeKey((_id(group),))
        for group, first, cell in requests.changed():
            self.first.updateValue((_id(group),), (first,))
            self.open.updateValue((_id(group),), (base64.b64encode(cell).decode(),))

    def close(self) -> None:
        pass


def _id(group: int) -> int | None:
    return None if group == C.NONE else int(group)


#: Ids of a block differ in so many low bits.
BLOCK_BITS = 16


def timed(stream: DataFrame) -> DataFrame:
    rows = client_requests(stream).where("tag in ('VCL_Log', 'Timestamp', 'VSL', 'End') and ts is not null")
    return rows.withColumn("at_ms", F.unix_millis("ts"))


def in_cells(rows: DataFrame, key_of: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, ...]], keys: list[str], delay: str, *more: Column, apart: bool = False) -> DataFrame:
    """A stream of timed records as cells by the keys that `key_of` finds, each with the time of its last record as `ts`."""
    found = rows.select(*C.NAMES, *more).mapInArrow(functools.partial(C.packed_by, key_of, apart), ", ".join([*[f"{k} long" for k in keys], "last_ms long", packed.PACKED]))
    return found.select(*keys, F.timestamp_millis("last_ms").alias("ts"), "packed").withWatermark("ts", delay)


def _block(rows: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return (rows[:, C.GROUP] >> BLOCK_BITS,)


def shard_column(batch: pa.RecordBatch) -> np.ndarray:
    """The column behind those of a record."""
    return batch.column(len(C.NAMES)).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _shard(rows: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return (shard_column(batch),)


def shard_of(shards: int) -> Column:
    hashed = F.conv(F.substring(F.md5(F.col("group_vxid").cast("string")), 1, 8), 16, 10).cast("long")
    return (hashed % shards).cast("int")


#: The state store that processors with timers and several states need, writing the changes that `state_changes` reads.
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    for name, value in _ROCKSDB.items():
        spark.conf.set(name, value)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside use that store; the session's settings come back behind."""
    before = {name: spark.conf.get(name, None) for name in _ROCKSDB}
    use_rocksdb(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def complete_requests(stream: DataFrame, options: TrackOptions = TrackOptions(), delay: str = "10 seconds") -> DataFrame:
    """Stream of complete requests (group_vxid, complete_reason, records), by end or timeout.

    State is kept by blocks of ids that follow each other, as those of requests at about the same time do: calls into state are
    per block and batch. Ids that lie far apart give the same result, at a call or more a request. What a task gathers of a block comes in one
    cell, late if its last record is; records of requests of whose own transaction nothing was gathered come one by one.
    """
    rows = in_cells(timed(stream), _block, ["block"], delay, apart=True)
    found = rows.groupBy("block").transformWithStateInPandas(_Requests(options.tx_timeout), C.DONE, "append", "eventTime")
    return found.mapInArrow(C.done_requests, COMPLETED)


def limit_requests(stream: DataFrame, options: TrackOptions = TrackOptions(), shards: int = 32, delay: str = "10 seconds") -> DataFrame:
    """Like complete_requests, but at most `tx_limit` requests are open at a time.

    The limit is shared evenly by `shards` (hash of the group), each with an order of its own: exact
    with one shard, an approximation that scales with more. A shard's share of a batch is put in order
    in one task's memory, so more shards or smaller batches bound it.
    """
    rows = in_cells(timed(stream), _shard, ["shard"], delay, shard_of(shards))
    found = rows.groupBy("shard").transformWithStateInPandas(_Limited(max(1, options.tx_limit // shards)), C.DONE, "append", "none")
    return found.mapInArrow(C.done_requests, COMPLETED)


def rules(completed: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """The batch rules over complete requests. Parts of one request that were completed apart stay apart."""
    first = F.element_at("records", 1)
    part = F.struct("group_vxid", "complete_reason", first["tx_seq"].alias("tx_seq"), first["rec_seq"].alias("rec_seq"))
    states = group_state(completed.select(part.alias("group_vxid"), F.inline("records")), options)
    return states.withColumn("complete_reason", F.col("group_vxid.complete_reason")).withColumn("group_vxid", F.col("group_vxid.group_vxid"))


#: A record of a request, in a row of its own.
_FLAT = f"group_vxid long, {RECORD}"


def flat(cells: DataFrame) -> DataFrame:
    """Rows of a column of cells: group_vxid and the columns of a record."""
    return cells.mapInArrow(C.flat_records, _FLAT)


def drain(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Requests that are still open in a stream's state, as complete_requests gives them, with reason 'drain'. The stream must be stopped."""
    state = spark.read.format("statestore").option("stateVarName", "recs").load(checkpoint)
    return record_struct(flat(state.select("list_element.packed")).select("group_vxid", F.struct(*_NAMES).alias("record")))


def _deadlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        due = packed.unpack(batch.column(0).to_pylist(), 3)
        yield pa.RecordBatch.from_arrays([pa.array(due[:, 0], pa.int64(), mask=due[:, 0] == C.NONE), pa.array(due[:, 1])], names=["group_vxid", "at"])


def dump_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """All records that a stream of complete_requests holds, a row each with its request's deadline, as of now or of the end of a batch."""
    read = lambda name: (spark.read.format("statestore").option("stateVarName", name) if batch is None else spark.read.format("statestore").option("stateVarName", name).option("batchId", batch)).load(checkpoint)
    deadline = read("deadline").select("value.packed").mapInArrow(_deadlines, "group_vxid long, at long").select("group_vxid", F.timestamp_millis("at").alias("deadline"))
    return flat(read("recs").select("list_element.packed")).join(deadline, "group_vxid", "left")


def _steps(versions: pd.DataFrame) -> pd.DataFrame:
    """What was opened and closed from one version of a block's deadlines to the next."""
    before, found = {}, []
    for batch, cell in versions.sort_values(["batch", "turn"])[["batch", "packed"]].itertuples(index=False):
        now = {} if cell is None else {group: at for group, at, _ in packed.unpack([cell], 3).tolist()}
        if batch >= 0:
            found += [(_id(g), batch, "closed", None) for g in before if g not in now] + [(_id(g), batch, "opened", at) for g, at in now.items() if g not in before]
        before = now
    return pd.DataFrame(found, columns=["group_vxid", "batch", "change", "at"]).astype({"group_vxid": "Int64", "batch": "int64", "at": "Int64"})


def state_changes(spark: SparkSession, checkpoint: str, first: int = 0, last: int | None = None) -> DataFrame:
    """What a stream of complete_requests opened and closed from batch to batch: group_vxid, batch, change ('opened', 'closed'), deadline.

    Read from the change feed of the deadlines in state: only what changed is read, and of the batch before the first the deadlines.
    """
    read = spark.read.format("statestore").option("stateVarName", "deadline")
    feed = spark.read.format("statestore").option("stateVarName", "deadline").option("readChangeFeed", True).option("changeStartBatchId", first)
    rows = (feed if last is None else feed.option("changeEndBatchId", last)).load(checkpoint)
    # a block's changes come in their order, as they are read in one task
    versions = rows.select(F.col("key.block").alias("block"), F.col("batch_id").alias("batch"), F.monotonically_increasing_id().alias("turn"), F.when(F.col("change_type") != "delete", F.col("value.packed")).alias("packed"))
    if first > 0:
        before = read.option("batchId", first - 1).load(checkpoint)
        versions = versions.unionByName(before.select(F.col("key.block").alias("block"), F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("turn"), F.col("value.packed").alias("packed")))
    changes = versions.groupBy("block").applyInPandas(_steps, "group_vxid long, batch long, change string, at long")
    return changes.select("group_vxid", "batch", "change", F.timestamp_millis("at").alias("deadline"))


def record_struct(rows: DataFrame) -> DataFrame:
    """(group_vxid, record) rows as requests with reason 'drain'."""
    return rows.groupBy("group_vxid").agg(F.lit("drain").alias("complete_reason"), F.array_sort(F.collect_list("record"), lambda x, y: _by_place(x, y)).alias("records"))


def flush(spark: SparkSession, done: DataFrame, checkpoint: str) -> DataFrame:
    """All requests of a stopped stream: those it completed and the open ones, with reason 'drain', as before the log is opened anew."""
    return done.unionByName(drain(spark, checkpoint))


def _by_place(x, y):
    a, b = F.struct(x["tx_seq"], x["rec_seq"]), F.struct(y["tx_seq"], y["rec_seq"])
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)

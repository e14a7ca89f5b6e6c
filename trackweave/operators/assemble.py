"""Assembly: one message per client request, from its and its subrequests' log records.

One exchange on `group_vxid`: the windows and the grouping share its partitioning. Groups are small
by nature (a request's own records). All limits are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..options import TrackOptions
from .filters import client_requests, tracked

_ORDER = ("tx_seq", "rec_seq")


def parse_entries(log: DataFrame) -> DataFrame:
    """Filter to what assembly uses and parse it: kind ('data', 'key', 'time', 'error'), body, cut, time."""
    kind = F.when(F.col("tag") == "VCL_Log", F.when(P.is_key(F.col("payload")), "key").otherwise("data")).when(F.col("tag") == "Timestamp", "time").otherwise("error")
    rows = tracked(client_requests(log)).select("group_vxid", "vxid", *_ORDER, kind.alias("kind"), P.body(F.col("payload")).alias("body"), P.response_time(F.col("payload")).alias("time"))
    return rows.withColumn("time", F.when(F.col("kind") == "time", F.col("time"))).withColumn("cut", P.cut_at_nul(F.col("body")))


def with_lengths(entries: DataFrame, options: TrackOptions) -> DataFrame:
    """Add the group's xid, the record length before each entry, and whether it overflows; drop what follows an overflow."""
    group = Window.partitionBy("group_vxid").orderBy(*_ORDER)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    is_data = F.col("kind") == "data"
    own = F.when(is_data, 1 + F.octet_length("cut")).otherwise(0)
    rows = entries.withColumn("xid", F.first_value("vxid").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("end_before", 4 + F.length(F.col("xid").cast("string")) + F.coalesce(F.sum(own).over(before), F.lit(0)))
    rows = rows.withColumn("overflow", is_data & (F.col("end_before") + F.octet_length("body") + 1 > options.max_reclen))
    return rows.withColumn("late", F.coalesce(F.max("overflow").over(before), F.lit(False))).where("not late").drop("late")


def group_state(log: DataFrame, options: TrackOptions) -> DataFrame:
    """One row per group with matching records: its parts, flags and counters."""
    rows = with_lengths(parse_entries(log), options)
    order = F.struct(*_ORDER)
    data, key = (F.col("kind") == "data") & ~F.col("overflow"), F.col("kind") == "key"
    fits = key & (F.octet_length("body") <= options.maxkeylen)
    own = rows.withColumns({"text": F.when(data, F.col("cut")), "accepted": F.when(fits, F.col("body")), "place": F.when(fits, order)})
    return own.groupBy("group_vxid").agg(
        F.min_by("vxid", order).alias("xid"),
        F.bool_or("overflow").alias("overflow"),
        F.bool_or(data).alias("has_data"),
        F.expr("listagg(text, '&') within group (order by tx_seq, rec_seq)").alias("text"),
        F.coalesce(F.max_by("accepted", "place"), F.lit("")).alias("key"),
        F.max("time").alias("time"),
        F.count_if(data & P.has_nul(F.col("body"))).alias("truncated"),
        F.count_if(key & ~fits).alias("key_overflows"),
        F.count_if(F.col("kind") == "error").alias("vsl_err"),
        F.max(F.col("end_before") + F.when(data, 1 + F.octet_length("cut")).otherwise(0)).cast("long").alias("len_end"),
        F.coalesce(F.max(F.octet_length("accepted")), F.lit(0)).alias("key_hi"),
    )


def outcome(options: TrackOptions) -> Column:
    too_long = F.col("len_end") + P.TIME_BYTES > options.max_reclen
    return F.when(F.col("overflow") | (F.col("has_data") & too_long), "len_overflow").when(~F.col("has_data"), "nodata").otherwise("submitted")


def finish(groups: DataFrame, options: TrackOptions, fallback_ts: Column | None) -> DataFrame:
    """Add outcome, message, end time and remaining counters to group states."""
    fallback = F.current_timestamp() if fallback_ts is None else fallback_ts
    micros = F.unix_micros(fallback)
    untimed = F.coalesce(F.col("time.s"), F.lit(0)) == 0
    time = F.when(untimed, F.struct(F.floor(micros / 1_000_000).cast("long").alias("s"), (micros % 1_000_000).alias("u"))).otherwise(F.col("time"))
    rows = groups.withColumn("outcome", outcome(options)).withColumn("end", time).withColumn("no_timestamp", F.col("has_data") & ~F.col("overflow") & untimed)
    done = F.col("outcome") == "submitted"
    rows = rows.withColumn("data", F.when(done, P.message(F.col("xid"), F.col("text"), F.col("end"))))
    return rows.select(
        "group_vxid",
        "xid",
        "data",
        F.octet_length("data").alias("data_bytes"),
        "key",
        F.when(done, P.to_timestamp(F.col("end"))).alias("req_end"),
        "no_timestamp",
        "outcome",
        "truncated",
        "key_overflows",
        "vsl_err",
        (F.col("len_end") + F.when(done, P.TIME_BYTES).otherwise(0)).alias("len_hi"),
        F.col("key_hi").cast("long").alias("key_hi"),
    )


def assemble(log: DataFrame, options: TrackOptions = TrackOptions(), fallback_ts: Column | None = None) -> DataFrame:
    """Messages of all groups that have data and fit: group_vxid, xid, data, data_bytes, key, req_end, no_timestamp.

    Groups without a usable response time end at `fallback_ts`, by default now.
    """
    rows = finish(group_state(log, options), options, fallback_ts).where("outcome = 'submitted'")
    return rows.select("group_vxid", "xid", "data", "data_bytes", "key", "req_end", "no_timestamp")

"""Audit: what became of every request group, and counters over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import TrackOptions
from .assemble import finish, group_state


def audit(log: DataFrame, transactions: DataFrame, options: TrackOptions = TrackOptions(), fallback_ts: Column | None = None) -> DataFrame:
    """One row per group of `transactions`, also for groups without a matching record (outcome 'nodata')."""
    done = finish(group_state(log, options), options, fallback_ts)
    groups = transactions.where("group_vxid is not null").select("group_vxid").distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("truncated", "key_overflows", "vsl_err", "len_hi", "key_hi")}
    rows = groups.join(done, "group_vxid", "left").withColumns(zero)
    return rows.withColumns({"outcome": F.coalesce("outcome", F.lit("nodata")), "no_timestamp": F.coalesce("no_timestamp", F.lit(False))})


def reader_counters(audited: DataFrame) -> DataFrame:
    """One row of totals over an audit. `vcl_log_err` cannot grow and stays 0."""
    return audited.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("outcome") == "submitted").alias("submitted"),
        F.count_if(F.col("outcome") == "nodata").alias("nodata"),
        F.coalesce(F.max("len_hi"), F.lit(0)).alias("len_hi"),
        F.coalesce(F.max("key_hi"), F.lit(0)).alias("key_hi"),
        F.count_if(F.col("outcome") == "len_overflow").alias("len_overflows"),
        F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated"),
        F.coalesce(F.sum("key_overflows"), F.lit(0)).alias("key_overflows"),
        F.lit(0).cast("long").alias("vcl_log_err"),
        F.count_if("no_timestamp").alias("no_timestamp"),
        F.coalesce(F.sum("vsl_err"), F.lit(0)).alias("vsl_err"),
    )

"""Filters over log records. Prefix tests are used where they suffice, as they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def client_requests(log: DataFrame) -> DataFrame:
    """Client-side records of request transactions."""
    return log.where("side = 'c' and tx_type = 'req'")


def tracked(log: DataFrame) -> DataFrame:
    """Track entries, response timestamps and log diagnostics."""
    return log.where("(tag = 'VCL_Log' and payload like 'track %') or (tag = 'Timestamp' and payload like 'Resp%') or tag = 'VSL'")


def tag_filter(log: DataFrame, patterns: dict[str, str | None]) -> DataFrame:
    """Records whose tag is listed and whose payload matches its pattern; None matches all."""
    keep = F.lit(False)
    for tag, pattern in patterns.items():
        own = F.col("tag") == tag
        keep = keep | (own if pattern is None else own & F.col("payload").rlike(pattern))
    return log.where(F.col("tag").isin(*patterns) & keep)


def groups_with(log: DataFrame, matching: DataFrame) -> DataFrame:
    """All records of the groups that have a record in `matching`."""
    return log.join(matching.select("group_vxid").distinct(), "group_vxid", "left_semi")

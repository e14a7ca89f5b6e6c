"""Routing: validate keys and payloads, find partitions, split off rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..options import TrackOptions
from ..steps import number_rows

#: Size up to which a partition table is broadcast: a topic has thousands of partitions at most.
MOST_PARTITIONS = 100_000


def reject_reason(key: str = "key", value: str = "value"):
    """'nokey', 'badkey' or null; empty payloads are 'nodata' whatever the key."""
    missing, empty = F.coalesce(F.octet_length(key), F.lit(0)) == 0, F.coalesce(F.octet_length(value), F.lit(0)) == 0
    return F.when(empty, "nodata").when(missing, "nokey").when(~P.is_hex_key(F.col(key)), "badkey")


def route(messages: DataFrame, options: TrackOptions = TrackOptions(), partitions: DataFrame | None = None) -> DataFrame:
    """Add reject_reason and partition, and shorten accepted keys to their first 8 bytes.

    `messages` has key and value, other columns pass. With `partitions(partition, available)`, keys
    of partitions that are not listed as available stay unassigned (null partition).
    """
    rows = messages.withColumn("reject_reason", reject_reason())
    ok = F.col("reject_reason").isNull()
    rows = rows.withColumn("partition", F.when(ok, P.partition_of(F.col("key"), options.num_partitions))).withColumn("key", F.when(ok, P.short_key(F.col("key"))).otherwise(F.col("key")))
    if partitions is None:
        return rows
    up = partitions.where("available").select("partition", F.lit(True).alias("up")).dropDuplicates(["partition"])
    if options.num_partitions <= MOST_PARTITIONS:
        up = F.broadcast(up.where(F.col("partition") < options.num_partitions))
    return rows.join(up, "partition", "left").withColumn("partition", F.when(F.col("up"), F.col("partition"))).drop("up").select(*rows.columns)


def split_rejects(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return routed.where("reject_reason is null"), routed.where("reject_reason is not null")


def reject_messages(routed: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """Rejects with a readable reason; the payload only with `log_error_data`."""
    text = F.when(F.col("reject_reason") == "nokey", "message shard key is missing").when(F.col("reject_reason") == "badkey", "message shard key is not hex").when(F.col("reject_reason") == "nodata", "message payload is empty")
    rows = split_rejects(routed)[1].withColumn("reject_text", text)
    return rows if options.log_error_data else rows.withColumn("value", F.lit(None).cast("string"))


def ordered(routed: DataFrame, by: str = "group_vxid") -> DataFrame:
    """In order of partition and `by`, dealt by range: files follow each other by name, and a hot partition is several tasks."""
    return routed.repartitionByRange("partition", by).sortWithinPartitions("partition", by)


def with_places(routed: DataFrame, by: str = "group_vxid") -> DataFrame:
    """Add `place`, the number of a message among those of its partition, from 1 in order of `by`.

    All rows are numbered by range first and each partition's least number is taken off, so no task holds
    a whole partition. The broadcast side has a row per topic partition.
    """
    rows = number_rows(routed, [F.col("partition"), F.col(by)], "place")
    first = rows.groupBy("partition").agg((F.min("place") - 1).alias("_before")).withColumnRenamed("partition", "_partition")
    rows = rows.join(F.broadcast(first), F.col("partition").eqNullSafe(F.col("_partition")))
    return rows.withColumn("place", (F.col("place") - F.col("_before")).cast("long")).drop("_partition", "_before")

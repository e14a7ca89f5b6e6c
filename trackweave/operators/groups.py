"""Resolve subrequests to the client request that they belong to."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..steps import materialize


def resolve_groups(transactions: DataFrame) -> DataFrame:
    """Fill `group_vxid` from the parent links, by pointer doubling over the subrequests that have subrequests of their own.

    All others only look their parent up once, at the end; a chain that has reached its end is left out of
    later rounds. There are log2(depth) rounds of one equi-join, each written, so plans stay small
    and a lost executor costs no earlier round. Whoever points to a transaction without a pointer is at its end.

    A parent that is not in the table ends a chain like a root, and so does a link to itself. Repeated
    rows of one vxid are all returned; where they name several parents the smallest counts. Rows with a
    null vxid stay without a group. Links that run in a circle are an error.
    """
    links = transactions.where("vxid is not null").groupBy("vxid").agg(F.min("parent_vxid").alias("up")).where("up <> vxid")
    above = links.select(F.col("up").alias("vxid")).distinct()
    open_ = materialize(links.join(above, "vxid", "left_semi"), "inner")
    settled: list[DataFrame] = []
    for _ in range(open_.count().bit_length() + 1):
        pointers = functools.reduce(DataFrame.unionByName, [*settled, open_]).select(F.col("vxid").alias("up"), F.col("up").alias("top"))
        stepped = materialize(open_.join(pointers, "up", "left").select("vxid", F.coalesce("top", "up").alias("up"), F.coalesce(F.col("top") != F.col("up"), F.lit(False)).alias("moved"), F.coalesce(F.col("top") == F.col("up"), F.lit(False)).alias("circle")), "stepped")
        if not stepped.where("circle").isEmpty():
            raise ValueError("parent links run in a circle")
        settled.append(stepped.where("not moved").select("vxid", "up"))
        open_ = stepped.where("moved").select("vxid", "up")
        if open_.isEmpty():
            break
    else:  # chains have fewer links than these rounds follow
        raise ValueError("parent links run in a circle")
    tops = functools.reduce(DataFrame.unionByName, settled).select(F.col("vxid").alias("_parent"), F.col("up").alias("_top"))
    # rows without a vxid are dealt by their parents, so that they do not meet in one task
    own = Window.partitionBy("vxid", F.when(F.col("vxid").isNull(), F.col("parent_vxid")))
    rows = transactions.drop("group_vxid").withColumn("_parent", F.when(F.col("vxid").isNotNull(), F.coalesce(F.min("parent_vxid").over(own), "vxid")))
    return rows.join(tops, "_parent", "left").withColumn("group_vxid", F.coalesce("_top", "_parent")).select(*transactions.columns)

"""Connected components of a link table, by alternating star contraction.

Each round is two groupings and two joins on the link table; a node with any number of links costs
one pre-aggregated minimum, never a collected group, and its links are dealt over several tasks to meet
it. The number of rounds grows with the logarithm of the size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


SALTS = 8


def _meet(links: DataFrame, least: DataFrame) -> DataFrame:
    """links(u, v) with the least neighbour m of u."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _meet(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _meet(down, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v); root is the smallest node of its component.

    Nodes are of any ordered type. Loops and repeated links are allowed; null ends are left out.
    """
    links = links.filter("u is not null and v is not null and u <> v").select("u", "v")
    state = None
    while True:
        links = materialize(_small_star(_large_star(links)), "links")
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

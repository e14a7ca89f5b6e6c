"""Table access and written steps for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import new_path, number_rows, shared_dir

__all__ = ["join_counted", "materialize", "new_path", "number_rows", "shared_dir", "table"]

#: Rows that a written step hands to a Python worker at once: texts and shingle sets are a few kB each, some far more.
BATCH_ROWS = 250
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends there and it survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when it holds at least this share of all rows, so there are at most as many hot keys as its inverse.
HOT = 1e-3


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with `keyed`, which has one row a key and the number `n` of the key's rows among `total`.

    Hot keys are broadcast, at most 1 / HOT of them at any size, and their rows stay where they are; only
    the others are shuffled, so no task reads all rows of a hot key.
    """
    hot = F.broadcast(keyed.where(F.col("n") >= HOT * total))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col("n") < HOT * total), on)
    return rows.join(hot, on).unionByName(cold).drop("n")

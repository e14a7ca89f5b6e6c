"""Shared folder, written steps and row numbers: what jobs need that read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`; only local runs may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends there and it survives lost executors."""
    path = new_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without one task that holds all rows.

    Rows are dealt by range, numbered inside each range, and shifted by the sizes of the ranges
    before; only those sizes (one per partition) are broadcast.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged.withColumn(into, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1), "ranges")
    sizes = ranged.groupBy("_range").count()
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before")

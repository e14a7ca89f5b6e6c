from pyspark.sql import functions as F

from trackweave.operators import assemble as A
from trackweave.operators import filters
from trackweave.operators import route as R
from trackweave.options import TrackOptions
from trackweave.schema import LOG_RECORD


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _log(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, 1, None, "req", "c", 0, 0, "VCL_Log", "track a", None)], LOG_RECORD).write.parquet(path)
    return spark.read.schema(LOG_RECORD).parquet(path)


def test_one_exchange(spark, tmp_path):
    """Windows and grouping of assembly share one shuffle."""
    plan = _plan(A.group_state(_log(spark, tmp_path), TrackOptions()))
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_push_down(spark, tmp_path):
    plan = _plan(filters.tracked(filters.client_requests(_log(spark, tmp_path))).select("vxid"))
    assert "EqualTo(side,c)" in plan and "StringStartsWith(payload,track )" in plan
    assert "ts" not in plan.split("ReadSchema")[1]


def test_routing_does_not_shuffle(spark):
    messages = spark.createDataFrame([("5ff1b68d", "x"), ("zz", "x"), (None, "x"), ("key", None), ("fedcba9876543210", "x")], "key string, value string")
    routed = R.route(messages)
    assert "Exchange" not in _plan(routed.where(F.col("partition") >= 0))
    assert [(r.key, r.reject_reason) for r in routed.collect()] == [("5ff1b68d", None), ("zz", "badkey"), (None, "nokey"), ("key", "nodata"), ("fedcba98", None)]

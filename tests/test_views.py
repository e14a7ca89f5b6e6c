from trackweave.plans import views

from .conftest import SF


def test_log_is_that_of_the_sql(spark, tmp_path):
    """The log that Spark makes has the rows of REC, with repeated and null keys too; line items are numbered once."""
    orders, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("orders", "lineitem"))
    odd = spark.createDataFrame([(None, 5, "O"), (3, None, None), (3, 8, "F"), (194, 9, "P")], "o_orderkey long, o_custkey long, o_orderstatus string")
    orders = orders.unionByName(odd.select(*[odd[c].cast(orders.schema[c].dataType) for c in odd.columns]), allowMissingColumns=True)
    items = items.unionByName(items.limit(1).selectExpr("* except (l_partkey, l_returnflag)"), allowMissingColumns=True)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = views.log(spark, str(tmp_path))
    want = spark.sql(views.REC, tx=views.transactions(spark, str(tmp_path)), orders=spark.read.parquet(str(tmp_path / "orders.parquet")))
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join Inner") == 1


def test_line_items_of_a_task_are_bounded(spark, monkeypatch):
    """Where the session's partitions would hold too many, line items are dealt to more, in the one shuffle that there was."""
    want = views.transactions(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(views, "SORTED_ROWS", rows // 9)
    found = views.transactions(spark, SF)
    assert found.exceptAll(want).isEmpty() and found.count() == want.count()
    numbered = found.where("tx_seq > 0")
    assert numbered.rdd.getNumPartitions() >= 9
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan

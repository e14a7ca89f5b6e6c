"""What shows on larger logs only, on small ones that have it."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from trackweave.plans import registered, streams

from .conftest import SF
from .oracle import TABLES, compare


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """The tables of the first orders, and again two million seconds later; one order has twenty line items."""
    path = tmp_path_factory.mktemp("long")
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create table {name} as select * from '{SF}/{name}.parquet'")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        db.sql(f"delete from {name} where {key} >= 300")
    db.sql("insert into lineitem select * exclude (i) replace (7 as l_orderkey, i as l_partkey) from (select * from lineitem limit 1), range(20) r(i)")
    db.sql("insert into orders select * replace (o_orderkey + 2000000 as o_orderkey) from orders")
    db.sql("insert into lineitem select * replace (l_orderkey + 2000000 as l_orderkey) from lineitem")
    for name in TABLES:
        db.sql(f"copy {name} to '{path}/{name}.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["state_dump", "stream_groups"])
def test_long_logs_and_deep_requests(spark, long_dir, name):
    """Deadlines that would pass before the log ends; chains deeper than four hops reach."""
    compare(spark, streams.R.QUERIES[name], streams.R.ORACLES[name], long_dir)


def test_files_beside_a_broken_one_are_not_lost(spark, monkeypatch):
    """A batch of several files, the last broken."""
    monkeypatch.setattr(streams, "FILE_ROWS", 1000)
    monkeypatch.setattr(streams, "files_a_batch", lambda *_: 4)
    compare(spark, streams.stream_follow, streams.R.ORACLES["stream_follow"], SF)


def test_request_texts_are_dealt_once(spark):
    """Paragraphs and requests are put together behind one exchange, and their files are small."""
    plan = registered._request_text(spark, SF, nested=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_are_compressed_and_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "TEXT_ROWS", 10)
    registered._write_text(spark.range(25).select(F.concat(F.lit("*   << Request  >> "), F.col("id").cast("string")).alias("value")).coalesce(1), str(tmp_path / "text"))
    names = [p.name for p in (tmp_path / "text").glob("part-*")]
    assert len(names) == 3 and all(n.endswith(".lz4") for n in names)
    assert spark.read.text(str(tmp_path / "text")).count() == 25


@pytest.mark.parametrize(("name", "folder", "least"), [("stream_sink_format", "sink", "_committed/*.json"), ("stream_ledger", "ledger", "deliveries/batch=*")])
def test_batches_of_messages_have_several_files(spark, monkeypatch, name, folder, least):
    """Sixteen files of messages are no sixteen batches, each in one task."""
    paths, new_path = {}, streams.new_path
    monkeypatch.setattr(streams, "new_path", lambda spark, name: paths.setdefault(name, new_path(spark, name)) if name == folder else new_path(spark, name))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        compare(spark, streams.R.QUERIES[name], streams.R.ORACLES[name], SF)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 3 < len(list(Path(paths[folder].removeprefix("file:")).glob(least))) < 8

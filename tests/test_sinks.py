import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackweave import steps
from trackweave.operators import groups
from trackweave.operators import route as R
from trackweave.options import TrackOptions
from trackweave.sources import logs, sinks


class Flaky:
    """Fails the n-th sends that are listed."""

    def __init__(self, codes, alive=True):
        self.codes, self.alive, self.log = list(codes), alive, []

    def open(self):
        self.log.append("open")

    def send(self, data, key):
        self.log.append(data)
        return self.codes.pop(0)

    def reconnect(self):
        self.log.append("reconnect")
        return self.alive

    def close(self):
        self.log.append("close")


def test_error_classes():
    rows = [Row(xid=i, data=f"é{i}", key=None) for i in range(4)]
    writer = Flaky([0, 3, -1, 0, -1, -1])
    got = [(r.xid, status, size) for r, status, size in sinks.deliver(writer, rows, "data", "key")]
    assert got == [(0, "sent", 3), (1, "recoverable", 3), (2, "reconnect", 3), (3, "failed", 3)]
    assert writer.log[0] == "open" and writer.log[-1] == "close" and writer.log.count("reconnect") == 2
    assert [s for _, s, _ in sinks.deliver(Flaky([-1], alive=False), rows[:1], "data", "key")] == ["failed"]


class Counting:
    def open(self): ...
    def send(self, data, key):
        return 0

    def reconnect(self):
        return True

    def close(self): ...


def test_nothing_lost_or_doubled(spark):
    messages = spark.range(1024).select(F.col("id").alias("xid"), F.concat(F.lit("foo=bar&record="), "id").alias("data"), F.lit("ab").alias("key")).repartition(5)
    got = sinks.write_messages(messages, Counting).collect()
    assert sorted(r.xid for r in got) == list(range(1024)) and {r.status for r in got} == {"sent"}
    assert sinks.write_messages(messages.limit(0), Counting).count() == 0


def test_files(spark, tmp_path):
    messages = spark.createDataFrame([("ab", "x=1: y"), (None, "z")], "key string, data string")
    path = str(tmp_path / "out")
    sinks.write_file(messages, path)
    sinks.write_file(messages, path, append=True)
    assert sorted(map(tuple, logs.read_sink_lines(spark, path).collect())) == [("", "z")] * 2 + [("ab", "x=1: y")] * 2
    sinks.write_file(messages, path)
    assert logs.read_sink_lines(spark, path).count() == 2


def test_key_data(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("0123456789:a:b\nab:\n\nlost:1\n")
    assert sorted(map(tuple, logs.read_key_data(spark, str(path), 2).collect())) == [("01234567", "a"), ("ab", "")]


def test_text_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("*   << Request  >> 591570\n-   VCL_Log        track url=/index.html\n-   Timestamp      Resp: 1430835449.167329 0 0\n\n**  << BeReq    >> 591571\n--  VCL_Log        track a\n")
    got = [tuple(r) for r in logs.read_text_log(spark, str(path)).orderBy("vxid", "rec_seq").collect()]
    assert got == [(591570, "request", 1, 1, "VCL_Log", "track url=/index.html"), (591570, "request", 1, 2, "Timestamp", "Resp: 1430835449.167329 0 0"), (591571, "bereq", 2, 1, "VCL_Log", "track a")]


def test_topic_options():
    assert sinks.topic_options("h:1", **{"ssl.key": "x"}) == {"kafka.bootstrap.servers": "h:1", "kafka.ssl.key": "x"}


def test_topic_rows(spark):
    routed = R.route(spark.createDataFrame([("12345678", "a"), ("fedcba9876543210", "b"), ("key", "c"), ("ab", None)], "key string, value string"), TrackOptions(num_partitions=3))
    rows = sinks.topic_rows(routed, TrackOptions(topic="t"))
    assert rows.columns == ["topic", "key", "value", "partition"]
    assert [tuple(r) for r in rows.collect()] == [("t", "12345678", "a", 0x12345678 % 3), ("t", "fedcba98", "b", 0xFEDCBA98 % 3)]
    with pytest.raises(ValueError, match="topic"):
        sinks.topic_rows(routed, TrackOptions())


def test_long_chain(spark):
    rows = [(None, 1, None, 0)] + [(None, i, i - 1, i) for i in range(2, 40)] + [(None, 100, 99, 0)]
    got = {r.vxid: r.group_vxid for r in groups.resolve_groups(spark.createDataFrame(rows, "group_vxid long, vxid long, parent_vxid long, tx_seq int")).collect()}
    assert all(got[i] == 1 for i in range(1, 40)) and got[100] == 99


_TX = "group_vxid long, vxid long, parent_vxid long, tx_seq int"


@pytest.mark.parametrize("circle", [[2, 3], [2, 3, 4], [2, 3, 4, 5, 6]])
def test_circles_are_errors(spark, circle):
    links = list(zip(circle, circle[1:] + circle[:1], strict=True))
    rows = [(None, 1, None, 0), (None, 20, circle[0], 0)] + [(None, a, b, 0) for a, b in links]
    with pytest.raises(ValueError, match="circle"):
        groups.resolve_groups(spark.createDataFrame(rows, _TX))


def test_repeated_null_and_looped_rows(spark):
    rows = [(None, 1, None, 0), (None, 2, 1, 0), (None, 2, 1, 0), (None, 3, 2, 0), (None, 3, 2, 7), (None, None, 1, 0), (None, 5, 5, 0), (9, 6, 5, 0)]
    got = sorted(groups.resolve_groups(spark.createDataFrame(rows, _TX)).collect(), key=str)
    assert sorted(((r.vxid, r.tx_seq, r.group_vxid) for r in got), key=str) == sorted([(1, 0, 1), (2, 0, 1), (2, 0, 1), (3, 0, 1), (3, 7, 1), (None, 0, None), (5, 0, 5), (6, 0, 5)], key=str)
    assert groups.resolve_groups(spark.createDataFrame([], _TX)).count() == 0


def test_rows_are_shuffled_twice_to_find_groups(spark):
    """By vxid for the parent that counts and by parent for its pointer, which itself is shuffled once; parents of several rows and a null vxid stay right."""
    rows = [(None, 1, None, 0), (None, 2, 4, 0), (None, 2, 1, 1), (None, 4, None, 0), (None, 5, 2, 0), (None, 6, 5, 0), (None, None, 5, 0)]
    found = groups.resolve_groups(spark.createDataFrame(rows, _TX))
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    assert sorted((r.vxid or 0, r.group_vxid or 0) for r in found.collect()) == [(0, 0), (1, 1), (2, 1), (2, 1), (4, 4), (5, 1), (6, 1)]


def test_places(spark):
    rows = spark.createDataFrame([(i % 3 if i % 3 else None, i) for i in range(50)], "partition int, group_vxid long")
    got = {}
    for r in R.with_places(rows).collect():
        got.setdefault(r.partition, []).append((r.group_vxid, r.place))
    assert all([place for _, place in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values()) and len(got) == 3


class _Cluster:
    """A session on a cluster without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        steps.shared_dir(_Cluster)


def test_topic_source(spark):
    assert logs.topic_source("t", "h:1", **{"ssl.key": "x"}) == {"subscribe": "t", "kafka.bootstrap.servers": "h:1", "startingOffsets": "latest", "failOnDataLoss": "false", "kafka.ssl.key": "x"}
    lines = spark.createDataFrame([('{"group_vxid": 1, "vxid": 2, "tag": "VSL", "payload": "x"}',), ("no json",), (None,)], "value string")
    assert [(r.group_vxid, r.vxid, r.tag) for r in logs.from_json_lines(lines).collect()] == [(1, 2, "VSL")]

import pytest
from pyspark.sql import functions as F

from trackweave.functions import payload as P
from trackweave.options import TrackOptions
from trackweave.operators import assemble as A

DIGITS = "1234567890" * 102 + "1234"

PAYLOADS = [
    ("1253687608 url=%2Fapp%2F", "data", "url=%2Fapp%2F"),
    ("url=%2Fapp%2F", "data", "url=%2Fapp%2F"),
    ("foo", "data", "foo"),
    ("foo url=%2Fapp%2F", "data", "foo url=%2Fapp%2F"),
    ("1253687608 foo=" + DIGITS, "data", "foo=" + DIGITS),
    ("foo=" + DIGITS, "data", "foo=" + DIGITS),
    ("1253687608 key foobarbazquux", "key", "foobarbazquux"),
    ("key foobarbazquux", "key", "foobarbazquux"),
    ("1253687608 key " + DIGITS, "key", DIGITS),
    ("key " + DIGITS, "key", DIGITS),
    (" ", "data", " "),
    ("  ", "data", "  "),
    ("4711foo", "data", "4711foo"),
    ("4711 ", "data", "4711 "),
    ("4711 key ", "key", ""),
    ("", "data", ""),
    ("key", "data", "key"),
    ("1 a\nb", "data", "a\nb"),
]


def test_payloads(spark):
    df = spark.createDataFrame([(i, f"track {p}") for i, (p, _, _) in enumerate(PAYLOADS)], "i int, p string")
    got = df.select("i", F.when(P.is_key(F.col("p")), "key").otherwise("data").alias("kind"), P.body(F.col("p")).alias("body")).orderBy("i").collect()
    assert [(r.kind, r.body) for r in got] == [(k, b) for _, k, b in PAYLOADS]


def test_times(spark):
    texts = ["Resp: 1430176881.682097 0.000281 0.000082", "Resp: 1430176881.000001 0.000281 0.000082", "Resp: 1.5 0", "Resp: x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = [r.t for r in df.select("i", P.response_time(F.col("p")).alias("t")).orderBy("i").collect()]
    assert [tuple(t) if t else None for t in got] == [(1430176881, 682097), (1430176881, 1), None, None, None]


@pytest.mark.parametrize(("key", "partition"), [("5ff1b68d", 1), ("5f9f78d5", 1), ("7c735b38", 0), ("80ffd2a7", 3), ("a3d0b3e9", 1), ("c923ca00", 0), ("key", None), ("", None), ("fedcba9876543210", 0)])
def test_partitions(spark, key, partition):
    assert spark.createDataFrame([(key,)], "k string").select(P.partition_of(F.col("k"), 4)).first()[0] == partition


def test_unsigned(spark):
    df = spark.createDataFrame([("0",), ("4294967295",), ("4294967296",), ("12a",), ("",), (None,), ("9" * 60,)], "v string")
    assert [r[0] for r in df.select(P.unsigned_32(F.col("v"))).collect()] == [0, 4294967295, None, None, None, None, None]


def test_nul(spark):
    row = spark.createDataFrame([("foo\0bar", "foo")], "a string, b string").select(P.cut_at_nul(F.col("a")), P.has_nul(F.col("a")), P.cut_at_nul(F.col("b")), P.has_nul(F.col("b"))).first()
    assert tuple(row) == ("foo", True, "foo", False)


def _one(spark, payloads, **options):
    rows = [(1, 1, None, "req", "c", 0, i, *p, None) for i, p in enumerate(payloads)]
    log = spark.createDataFrame(rows, "group_vxid long, vxid long, parent_vxid long, tx_type string, side string, tx_seq int, rec_seq int, tag string, payload string, ts timestamp")
    return A.group_state(log, TrackOptions(**options)).first()


def test_exact_limit(spark):
    """XID=1 has 5 bytes; data that fills the record to the limit is kept, one more byte discards the group."""
    assert not _one(spark, [("VCL_Log", "track " + "x" * 1018)]).overflow
    assert _one(spark, [("VCL_Log", "track " + "x" * 1018)]).len_end == 1024
    assert _one(spark, [("VCL_Log", "track " + "x" * 1019)]).overflow


def test_whole_record(spark):
    rows = [(591570, 591570, None, "req", "c", 0, i, *p, None) for i, p in enumerate([("VCL_Log", "track url=/index.html"), ("VCL_Log", "track http_Host=foo.bar.org"), ("VCL_Log", "track key 12345678"), ("Timestamp", "Resp: 1430835449.167329 0 0")])]
    log = spark.createDataFrame(rows, "group_vxid long, vxid long, parent_vxid long, tx_type string, side string, tx_seq int, rec_seq int, tag string, payload string, ts timestamp")
    row = A.assemble(log).first()
    assert row.data == "XID=591570&url=/index.html&http_Host=foo.bar.org&req_endt=1430835449.167329" and row.key == "12345678" and row.data_bytes == len(row.data)
    fields = spark.createDataFrame([row]).select(P.fields(F.col("data"))).first()[0]
    assert fields["url"] == "/index.html"


def test_options():
    assert TrackOptions().max_reclen == 1024 and TrackOptions.of(maxkeylen=7).maxkeylen == 7
    with pytest.raises(ValueError, match="unknown"):
        TrackOptions.of(max_len=3)
    with pytest.raises(ValueError, match="chunk_size"):
        TrackOptions(chunk_size=1)

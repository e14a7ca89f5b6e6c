import gzip

import duckdb
import pytest

from trackweave.llm import warc as W
from trackweave.llm.common import new_path

SCHEMA = "page_id long, url string, html string, record_id string"


def _pages(spark):
    long = "é<p>\r\n\r\nWARC/1.1\r\n</p>" * 9000
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * 20, "z") for i in range(40)]
    rows += [(100, None, None, "z"), (101, "a\r\nb", "", "z"), (102, "u", "short", "z"), (103, "u", "short", "z"), (104, "u", long, "z"), (50, "u", long, "z"), (105, "u", "0\r\n\r\n" * 50, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(spark):
    pages = _pages(spark)
    frame = pages.toPandas()
    db = duckdb.connect()
    db.sql("create view pages as select * from frame")
    want = sorted(db.sql(W.ORACLE).fetchall())
    for compression, segment in (("gzip", 1000), ("none", 10**6)):
        path = new_path(spark, "warc")
        W.write_warc(pages, path, segment_chars=segment, chunk_chars=300, records_per_file=20, compression=compression)
        assert sorted(map(tuple, W.page_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want
    texts = {r.page_id: r.html or "" for r in pages.collect()}
    whole = W.payloads(W.reassemble(W.read_warc(spark, path)))
    got = {r.page_id: bytes(r.payload).decode() for r in whole.select(W.page_id("record_id", "long").alias("page_id"), "payload").collect()}
    assert got[100] == "" and got[50] == texts[50] and got[105] == texts[105] and 104 not in got


def test_empty(spark):
    path = new_path(spark, "warc")
    W.write_warc(_pages(spark).limit(0), path)
    assert W.page_records(spark, path).count() == 0


def _records(data):
    return list(W.parse_records(data.split(W._BEGIN)))


def test_faults():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [r["block"] for r in _records(record * 3)] == [b"abcde"] * 3
    for bad in (record[:-8], b"x" + record, record[:20], record.replace(b"abcde", b"abcdefg"), record + record[:-6]):
        with pytest.raises(ValueError, match="WARC"):
            _records(bad)
    held = b"x" * 7 + W._BEGIN * 3 + b"\r\n"
    block = record.replace(b"abcde", held).replace(b": 5", b": %d" % len(held))
    assert [r["block"] for r in _records(block + record)] == [held, b"abcde"]
    assert W.decode_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert W.decode_http(b"HTTP/1.1 200 OK\r\n\r\nabc") == b"abc"


def test_archives_of_others(spark, tmp_path):
    """Each record a gzip member, WARC/1.0, bytes that are not UTF-8, many files; blocks come back as they are."""
    blocks = [bytes([i, 0xFF, 0xC3]) * (i + 1) + b"\r\n\r\n" * (i % 3) for i in range(30)]
    for at in range(3):
        members = [gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(blocks[i])) + blocks[i] + b"\r\n\r\n") for i in range(at, 30, 3)]
        (tmp_path / f"{at}.warc.gz").write_bytes(b"".join(members))
    got = {r.record_id: bytes(r.block) for r in W.read_warc(spark, str(tmp_path)).collect()}
    assert got == {f"<{i}>": block for i, block in enumerate(blocks)}


def test_missing_segment(spark):
    rows = [("a", "response", None, None, None, 1, None, None, b"ab"), ("a:3", "continuation", None, None, None, 3, "a", 4, b"cd")]
    with pytest.raises(Exception, match="segments are missing"):
        W.reassemble(spark.createDataFrame(rows, W.RECORDS)).collect()
    whole = [*rows[:1], ("a:2", "continuation", None, None, None, 2, "a", 4, b"cd"), ("a:2", "continuation", None, None, None, 2, "a", 4, b"cd")]
    assert [b"".join(map(bytes, r.blocks)) for r in W.reassemble(spark.createDataFrame(whole, W.RECORDS)).collect()] == [b"abcd"]


def test_repeated_rows_and_null_ids(spark):
    long = "é<p>\r\n</p>" * 900
    rows = [(1, "a", long, "z")] * 3 + [(2, "b", long, "z")] * 2 + [(None, "c", long, "z")] * 2 + [(None, "d", "alone" * 50, "z")] * 3
    rows += [(3, "e", "short", "z")] * 2 + [(None, "f", None, "z")] * 2 + [(4, "g", "once", "z")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar, record_id varchar)")
    db.executemany("insert into pages values (?, ?, ?, ?)", rows)
    want = sorted(db.sql(W.ORACLE).fetchall(), key=str)
    path = new_path(spark, "warc")
    W.write_warc(pages, path, segment_chars=1000, chunk_chars=300)
    assert sorted(map(tuple, W.page_records(spark, path).collect()), key=str) == want and len(want) == len(rows)
    ids = [r.record_id for r in W.reassemble(W.read_warc(spark, path)).collect()]
    assert len(ids) == len(set(ids)) == len(rows)

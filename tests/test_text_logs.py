from trackweave.operators.assemble import assemble
from trackweave.sources import logs

TEXT = """-   VCL_Log        track before any head
*   << Request  >> 591570    
-   Begin          req 591569 rxreq
-   VCL_Log        track url=/index.html
-   VCL_Log        track http_Host=foo.bar.org
-   VCL_Log        track key 12345678
**  << BeReq    >> 591571    
--  VCL_Log        track backend=1
**  << Request  >> 591572    
--  VCL_Log        track esi=1
*** << Request  >> 591573    
--- VCL_Log        track esi=2
*4* << Request  >> 591574    
-4- VCL_Log        track esi=3
-4- Timestamp      Resp: 1430835449.167329 0.000681 0.000352
**  << Request  >> 591575    
--  VCL_Log        track esi=4

*   << Request  >> 7         
-   VCL_Log        track  two  blanks
-   Debug
no record
-   Timestamp      Resp: 1430835450.000001 0.1 0.1

*   << Session  >> 8         
-   Begin          sess 0 HTTP/1
"""


def read(spark, tmp_path, text):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text(text)
    return logs.read_request_log(spark, str(tmp_path / "log"))


def test_nesting(spark, tmp_path):
    log = read(spark, tmp_path, TEXT)
    got = {(r.vxid, r.tx_type, r.side): (r.group_vxid, r.parent_vxid, r.tx_seq) for r in log.collect()}
    assert got == {
        (591570, "req", "c"): (591570, None, 0),
        (591571, "bereq", "b"): (591570, 591570, 1),
        (591572, "req", "c"): (591570, 591570, 2),
        (591573, "req", "c"): (591570, 591572, 3),
        (591574, "req", "c"): (591570, 591573, 4),
        (591575, "req", "c"): (591570, 591570, 5),
        (7, "req", "c"): (7, None, 0),
        (8, "session", None): (8, None, 0),
    }
    assert [(r.rec_seq, r.tag, r.payload) for r in log.where("vxid = 7").orderBy("rec_seq").collect()] == [(0, "VCL_Log", "track  two  blanks"), (1, "Debug", ""), (3, "Timestamp", "Resp: 1430835450.000001 0.1 0.1")]


def test_messages(spark, tmp_path):
    messages = {r.xid: (r.data, r.key) for r in assemble(read(spark, tmp_path, TEXT)).collect()}
    assert messages == {
        591570: ("XID=591570&url=/index.html&http_Host=foo.bar.org&esi=1&esi=2&esi=3&esi=4&req_endt=1430835449.167329", "12345678"),
        7: ("XID=7& two  blanks&req_endt=1430835450.000001", ""),
    }


def test_odd_texts(spark, tmp_path):
    assert read(spark, tmp_path, "").count() == 0
    (tmp_path / "log" / "a.txt").write_bytes(TEXT.replace("\n", "\r\n").encode())
    assert logs.read_request_log(spark, str(tmp_path / "log")).where("vxid = 591574 and group_vxid = 591570 and payload = 'track esi=3'").count() == 1
    (tmp_path / "log" / "a.txt").write_text("*** << Request  >> 5\n--- VCL_Log track deep first\n")
    assert [(r.group_vxid, r.parent_vxid) for r in logs.read_request_log(spark, str(tmp_path / "log")).collect()] == [(5, None)]


def test_requests_are_not_cut_by_splits(spark, tmp_path):
    """Small splits: a request stays whole, whichever split its text begins in."""
    (tmp_path / "log").mkdir()
    one = "*   << Request  >> {}\n" + "".join(f"{'-' * d + ' ' * (4 - d)}VCL_Log  track x={i}\n" for d, i in ((1, 0),)) + "**  << Request  >> {}\n--  VCL_Log  track y=1\n"
    (tmp_path / "log" / "a.txt").write_text("\n".join(one.format(2 * i, 2 * i + 1) for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        log = logs.read_request_log(spark, str(tmp_path / "log"))
        assert log.rdd.getNumPartitions() > 5
        got = sorted((r.group_vxid, r.vxid, r.parent_vxid) for r in log.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([(2 * i, 2 * i, None) for i in range(400)] + [(2 * i, 2 * i + 1, 2 * i) for i in range(400)])


def test_parents_of_flat_dumps(spark, tmp_path):
    text = "".join(f"*   << {kind} >> {v}\n-   Begin  {b}\n-   VCL_Log  track {v}\n\n" for kind, v, b in [("Request ", 1, "req 9 rxreq"), ("Request ", 2, "req 1 esi"), ("BeReq   ", 3, "bereq 2 fetch"), ("Request ", 4, "req 2 restart")])
    got = {r.vxid: (r.parent_vxid, r.group_vxid) for r in logs.nested_by_begin(read(spark, tmp_path, text)).collect()}
    assert got == {1: (None, None), 2: (1, None), 3: (2, None), 4: (None, None)}

import random

from pyspark.sql import functions as F

from trackweave.operators import audit as U
from trackweave.options import TrackOptions

from .model import assemble

SCHEMA = "group_vxid long, vxid long, parent_vxid long, tx_type string, side string, tx_seq int, rec_seq int, tag string, payload string, ts timestamp"


def _payload(rng):
    body = "".join(rng.choice(["a", "é", "ü", "=", "%2F", "\0", "7"]) for _ in range(rng.randint(0, 14)))
    return rng.choice(["track ", "track 4711 ", "track "]) + rng.choice(["", "", "key "]) + body


def test_random_groups(spark):
    """Accepted records, outcomes and counters equal a record-at-a-time model."""
    rng, rows, groups = random.Random(3), [], {}
    for g in range(1, 601):
        groups[g] = []
        for tx in range(rng.randint(0, 3)):
            for rec in range(rng.randint(0, 5)):
                tag, payload = rng.choice([("VCL_Log", _payload(rng))] * 4 + [("Timestamp", f"Resp: {rng.choice([0, 5, 1430000000])}.{rng.randint(0, 999999):06d} 0 0"), ("Timestamp", "Resp: 1.5 0"), ("VSL", "error"), ("ReqURL", "/"), ("VCL_Log", "other")])
                rows.append((g, g * 10 + tx, None, "req", "c", tx, rec, tag, payload, None))
                if tag == "VSL" or payload.startswith(("track ", "Resp")):
                    groups[g].append((tx, rec, g * 10 + tx, tag, payload))
    options = TrackOptions(max_reclen=60, maxkeylen=8)
    log = spark.createDataFrame(rows, SCHEMA)
    transactions = spark.createDataFrame([(g,) for g in groups], "group_vxid long")
    audited = U.audit(log, transactions, options, F.timestamp_seconds(F.lit(77)))
    got = {r.group_vxid: r for r in audited.collect()}
    assert len(got) == len(groups)
    for g, records in groups.items():
        want = assemble(records, 60, 8, (77, 0)) if records else {"outcome": "nodata", "truncated": 0, "key_overflows": 0, "vsl_err": 0, "len_hi": 0, "key_hi": 0, "no_timestamp": False, "data": None}
        for name, value in want.items():
            if name != "key" or want["outcome"] == "submitted":
                assert got[g][name] == value, (g, name, records)
    total = U.reader_counters(audited).first()
    assert total.seen == total.submitted + total.nodata + total.len_overflows == len(groups)


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert U.audit(log, log).count() == 0
    assert U.reader_counters(U.audit(log, log)).first().seen == 0

"""Table schemas, as DDL."""

LOG_RECORD = "group_vxid long, vxid long, parent_vxid long, tx_type string, side string, tx_seq int, rec_seq int, tag string, payload string, ts timestamp"
TRANSACTION = "group_vxid long, vxid long, parent_vxid long, tx_type string, tx_seq int"
PARTITIONS = "partition int, available boolean"
DELIVERY = "worker string, xid long, submit_ts timestamp, done_ts timestamp, status string, bytes int"
INCIDENT = "ts timestamp, kind string, detail string"

"""A request log derived from the star-schema tables, in SQL that Spark and DuckDB both run.

An order is a client request and its line items are subrequests; events are deliveries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs
from ..steps import new_path

TX = """
select o_orderkey*64 as group_vxid, o_orderkey*64 as vxid, cast(null as bigint) as parent_vxid, 0 as tx_seq,
       cast(null as bigint) as pk, cast(null as varchar(1)) as rf, o_orderkey as ok
from {orders}
union all
select ok*64, ok*64+n, case when n<=3 then ok*64 else ok*64+n-1 end, cast(n as int), pk, rf, ok from (
  select l_orderkey ok, l_partkey pk, l_returnflag rf,
         row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,
           l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) n from {lineitem}) s
"""

REC = """
select group_vxid, vxid, parent_vxid, 'req' as tx_type, 'c' as side, tx_seq, 0 as rec_seq, 'ReqURL' as tag, '/index.html' as payload from {tx} where tx_seq=0
union all select group_vxid,vxid,parent_vxid,'req','c',tx_seq,1,'VCL_Log','other note' from {tx} where tx_seq=0
union all select group_vxid,vxid,parent_vxid,'req','c',0,2,'VCL_Log',concat('track status=',o_orderstatus) from {tx} join {orders} on ok=o_orderkey where tx_seq=0 and ok%11<>0
union all select group_vxid,vxid,parent_vxid,'req','c',0,3,'VCL_Log',
   concat('track key ', case when ok%97=0 then repeat('a',130) when ok%10=1 then concat('zz',cast(o_custkey as varchar(20)))
     when ok%10=3 then concat(lpad(lower(hex((o_custkey*2654435761)%4294967296)),8,'0'),'fedcba98') else lower(hex(o_custkey)) end)
   from {tx} join {orders} on ok=o_orderkey where tx_seq=0 and ok%10<>0
union all select group_vxid,vxid,parent_vxid,'req','c',0,4,'Timestamp',
   concat('Resp: ',cast(1430000000+ok as varchar(20)),'.',lpad(cast((o_custkey*7919)%1000000 as varchar(20)),6,'0'),' 0.000681 0.000352')
   from {tx} join {orders} on ok=o_orderkey where tx_seq=0 and ok%13<>0
union all select group_vxid,vxid,parent_vxid,'req','c',tx_seq,0,'VCL_Log',
   concat('track ', case when pk%5=0 then concat(cast(vxid as varchar(20)),' ') else '' end, 'part=',cast(pk as varchar(20)),',',rf) from {tx} where tx_seq>0
union all select group_vxid,vxid,parent_vxid,'bereq','b',tx_seq,1,'VCL_Log','track backend=1' from {tx} where tx_seq=1
"""

#: The rows of REC in Spark: line items are numbered once, and orders are joined once, for all kinds of records.
LOG = """
select ok*64 as group_vxid, ok*64 as vxid, cast(null as bigint) as parent_vxid, 'req' as tx_type, 'c' as side, 0 as tx_seq, r.rec_seq, r.tag, r.payload from (
  select o_orderkey as ok, explode(array(
    named_struct('rec_seq', 0, 'tag', 'ReqURL', 'payload', '/index.html'), named_struct('rec_seq', 1, 'tag', 'VCL_Log', 'payload', 'other note'))) as r from {orders})
union all
select ok*64, ok*64, cast(null as bigint), 'req', 'c', 0, r.rec_seq, r.tag, r.payload from (
  select ok, explode(filter(array(
    case when ok%11<>0 then named_struct('rec_seq', 2, 'tag', 'VCL_Log', 'payload', concat('track status=', o_orderstatus)) end,
    case when ok%10<>0 then named_struct('rec_seq', 3, 'tag', 'VCL_Log', 'payload',
      concat('track key ', case when ok%97=0 then repeat('a',130) when ok%10=1 then concat('zz',cast(o_custkey as varchar(20)))
        when ok%10=3 then concat(lpad(lower(hex((o_custkey*2654435761)%4294967296)),8,'0'),'fedcba98') else lower(hex(o_custkey)) end)) end,
    case when ok%13<>0 then named_struct('rec_seq', 4, 'tag', 'Timestamp', 'payload',
      concat('Resp: ',cast(1430000000+ok as varchar(20)),'.',lpad(cast((o_custkey*7919)%1000000 as varchar(20)),6,'0'),' 0.000681 0.000352')) end
  ), x -> x is not null)) as r from (select o_orderkey as ok from {orders}) t join {orders} on ok=o_orderkey)
union all
select group_vxid, vxid, parent_vxid, r.tx_type, r.side, tx_seq, r.rec_seq, 'VCL_Log', r.payload from (
  select *, explode(filter(array(
    named_struct('tx_type', 'req', 'side', 'c', 'rec_seq', 0, 'payload', concat('track ', case when pk%5=0 then concat(cast(vxid as varchar(20)),' ') else '' end, 'part=',cast(pk as varchar(20)),',',rf)),
    case when tx_seq=1 then named_struct('tx_type', 'bereq', 'side', 'b', 'rec_seq', 1, 'payload', 'track backend=1') end
  ), x -> x is not null)) as r from {tx} where tx_seq>0)
"""

DOC = """
select doc_id as group_vxid, doc_id as vxid, cast(null as bigint) as parent_vxid, 'req' as tx_type, 'c' as side, 0 as tx_seq, 0 as rec_seq,
       'VCL_Log' as tag, concat('track doc=', text) as payload from {documents}
union all select doc_id, doc_id, cast(null as bigint), 'req', 'c', 0, 1, 'VCL_Log', concat('track key ', source, lang) from {documents}
union all select doc_id, doc_id, cast(null as bigint), 'req', 'c', 1, 0, 'VCL_Log', concat('track a=', lang, chr(0), source) from {documents}
"""

EV = """
select event_id as xid, concat('w', cast(user_id % 20 as varchar(2))) as worker, cast(ts as timestamp) as submit_ts,
       case event_type when 'error' then 'failed' when 'signup' then 'reconnect' when 'view' then 'recoverable' else 'sent' end as status,
       value, props, event_type from {events}
"""

#: Times end here where a request has no response time of its own.
FALLBACK_TS = "2015-05-05 12:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items that one task numbers, about, whatever the size of the table.
SORTED_ROWS = 1_000_000


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, dealt by order for their numbering where the session's partitions would be too large to sort."""
    rows = _table(spark, sf_dir, "lineitem")
    parts = -(-rows.count() // SORTED_ROWS)
    return rows.repartition(parts, "l_orderkey") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TX, orders=_table(spark, sf_dir, "orders"), lineitem=_line_items(spark, sf_dir))


_STORED: dict[tuple[str, str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    return (spark.sparkContext.applicationId, sf_dir, name)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's rows; transactions are read where they are stored, as for streams, and numbered otherwise."""
    tx = stored_transactions if _key(spark, sf_dir, "transactions") in _STORED else transactions
    return spark.sql(LOG, tx=tx(spark, sf_dir), orders=_table(spark, sf_dir, "orders"))


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The path of a view that is written once for the application and its tables."""
    key = _key(spark, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        make(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return _STORED[key]


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as a stored table, read as a batch."""
    return logs.read_log(spark, _stored(spark, sf_dir, "log", log))


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_stored(spark, sf_dir, "transactions", transactions))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOC, documents=_table(spark, sf_dir, "documents"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivery rows; `done_ts` is 20 seconds per unit of value later."""
    rows = spark.sql(EV, events=_table(spark, sf_dir, "events"))
    done = F.timestamp_micros(F.unix_micros("submit_ts") + F.floor(F.col("value") * 20_000_000).cast("long"))
    return rows.withColumns({"done_ts": done, "bytes": F.octet_length("props")})


def cte() -> str:
    """The same views for DuckDB, to put behind `with`."""
    names = {x: x for x in ("orders", "lineitem", "tx", "documents", "events")}
    tx, rec, doc, ev = (x.format(**names) for x in (TX, REC, DOC, EV))
    done = "make_timestamp(epoch_us(submit_ts) + cast(floor(value * 20000000) as bigint))"
    return f"tx as materialized ({tx}), rec as materialized ({rec}), doc as ({doc}), ev as (select *, {done} as done_ts, octet_length(encode(props)) as bytes from ({ev}) e)"

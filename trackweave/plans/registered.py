"""The registered queries: every operator over the whole views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators import assemble as A
from ..operators import audit as U
from ..operators import filters, groups, metrics
from ..operators import group_query as G
from ..operators import route as R
from ..options import TrackOptions
from ..sources import logs, plugin, sinks
from ..steps import materialize, new_path
from . import sql, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _fallback() -> Column:
    return F.lit(views.FALLBACK_TS).cast("timestamp")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assemble(views.stored_log(spark, sf_dir), TrackOptions(), _fallback())


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route(_messages(spark, sf_dir).select("group_vxid", "key", F.col("data").alias("value")), TrackOptions())


_STATES = sql.states("rec", TrackOptions())


@query(sql.with_(_STATES, then=sql.MESSAGES))
def assemble(spark, sf_dir):
    return _messages(spark, sf_dir)


@query(sql.with_(then="select group_vxid, vxid, tag, payload from rec where (tag = 'VCL_Log' and regexp_matches(payload, '^track ')) or (tag = 'Timestamp' and regexp_matches(payload, '^Resp')) or tag = 'VSL'"))
def tag_filter(spark, sf_dir):
    return filters.tag_filter(views.stored_log(spark, sf_dir), {"VCL_Log": "^track ", "Timestamp": "^Resp", "VSL": None}).select("group_vxid", "vxid", "tag", "payload")


@query(sql.with_("keyed as (select distinct group_vxid from rec where side = 'c' and tag = 'VCL_Log' and payload like 'track key %')", then="select rec.group_vxid, tx_seq, rec_seq, tag from rec join keyed on rec.group_vxid = keyed.group_vxid"))
def group_semi(spark, sf_dir):
    log = views.stored_log(spark, sf_dir)
    return filters.groups_with(log, log.where("side = 'c' and tag = 'VCL_Log' and payload like 'track key %'")).select("group_vxid", "tx_seq", "rec_seq", "tag")


def _expressions():
    track = G.record("vcl_log", "~", "^track ")
    keyed, timed = G.record("VCL_Log", "~", "^track key ", side="c"), G.record("Timestamp", prefix="Resp")
    return {
        "tracked": track,
        "no_key_but_timed": ~keyed & timed,
        "slow": G.record("Timestamp", ">=", 1430000100.5, prefix="resp", field=1) | G.record("Timestamp", "<", 1430000050, prefix="Resp", field=1),
        "status_f": G.record("VCL_Log", "eq", "track status=F"),
        "neither": ~(keyed | timed),
        "no_url_or_other": ~G.record("ReqURL", "!~", "^/index") & (G.record("VCL_Log", "ne", "other note") | ~track),
    }


@query(sql.with_(then="""select group_vxid, tracked, not keyed and timed as no_key_but_timed, slow, status_f, not (keyed or timed) as neither, not odd_url and (other or not tracked) as no_url_or_other from (
  select group_vxid, bool_or(tag = 'VCL_Log' and payload like 'track %') as tracked, bool_or(side = 'c' and tag = 'VCL_Log' and payload like 'track key %') as keyed,
    bool_or(tag = 'Timestamp' and payload like 'Resp:%') as timed,
    coalesce(bool_or(moment >= 1430000100.5 or moment < 1430000050), false) as slow,
    bool_or(tag = 'VCL_Log' and payload = 'track status=F') as status_f, bool_or(tag = 'ReqURL' and not starts_with(payload, '/index')) as odd_url, bool_or(tag = 'VCL_Log' and payload <> 'other note') as other
  from (select *, case when tag = 'Timestamp' and payload like 'Resp:%' then try_cast(split_part(payload, ' ', 2) as double) end as moment from rec) r group by group_vxid) f"""))
def group_expressions(spark, sf_dir):
    """Which of several queries are true of each group, in one grouping."""
    return G.match_groups(views.stored_log(spark, sf_dir), _expressions())


@query(sql.with_("flg as (select group_vxid, bool_or(side = 'c' and tag = 'VCL_Log' and payload like 'track key %') as keyed, bool_or(tag = 'Timestamp' and payload like 'Resp:%') as timed from rec group by group_vxid)", then="select rec.group_vxid, vxid, tx_seq, rec_seq, tag, payload from rec join flg on rec.group_vxid = flg.group_vxid where not keyed and timed"))
def group_query(spark, sf_dir):
    """All records of the groups with a response time and no key."""
    return G.filter_groups(views.stored_log(spark, sf_dir), _expressions()["no_key_but_timed"]).select("group_vxid", "vxid", "tx_seq", "rec_seq", "tag", "payload")


@query(sql.with_(sql.entries("(select * from rec union all select * from doc)"), then="select group_vxid, vxid, tx_seq, rec_seq, kind, sha256(body) as body_sha, octet_length(encode(body)) as bytes from ent where kind in ('data', 'key')"))
def parse_entries(spark, sf_dir):
    log = views.stored_log(spark, sf_dir).drop("ts").unionByName(views.document_log(spark, sf_dir))
    rows = A.parse_entries(log).where("kind in ('data', 'key')")
    return rows.select("group_vxid", "vxid", "tx_seq", "rec_seq", "kind", F.sha2("body", 256).alias("body_sha"), F.octet_length("body").alias("bytes"))


@query(sql.with_(sql.entries("rec"), then="select group_vxid, s, u, make_timestamp(s * 1000000 + u) as at, concat('req_endt=', cast(s as varchar), '.', lpad(cast(u as varchar), 6, '0')) as text from ent where kind = 'time'"))
def parse_time(spark, sf_dir):
    rows = A.parse_entries(views.stored_log(spark, sf_dir)).where("kind = 'time'")
    return rows.select("group_vxid", F.col("time.s").alias("s"), F.col("time.u").alias("u"), P.to_timestamp(F.col("time")).alias("at"), P.format_time(F.col("time")).alias("text"))


@query("select event_id, case when regexp_full_match(v, '[0-9]+') and try_cast(v as hugeint) <= 4294967295 then cast(v as bigint) end as number from (select event_id, concat(cast(event_id * 7919 as varchar), case when event_id % 7 = 0 then 'a' when event_id % 5 = 0 then '00000' else '' end) as v from events) e")
def parse_uint(spark, sf_dir):
    text = F.concat((F.col("event_id") * 7919).cast("string"), F.when(F.col("event_id") % 7 == 0, "a").when(F.col("event_id") % 5 == 0, "00000").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", P.unsigned_32(text).alias("number"))


@query(sql.with_(sql.entries("doc"), then="select group_vxid, split_part(body, chr(0), 1) as cut, octet_length(encode(body)) as bytes from ent where instr(body, chr(0)) > 0"))
def nul_truncate(spark, sf_dir):
    rows = A.parse_entries(views.document_log(spark, sf_dir)).where(P.has_nul(F.col("body")))
    return rows.select("group_vxid", "cut", F.octet_length("body").alias("bytes"))


@query(sql.with_(then="select vxid, parent_vxid, tx_seq, group_vxid from tx"))
def resolve_groups(spark, sf_dir):
    tx = views.stored_transactions(spark, sf_dir).select(F.lit(None).cast("long").alias("group_vxid"), "vxid", "parent_vxid", "tx_seq")
    return groups.resolve_groups(tx).select("vxid", "parent_vxid", "tx_seq", "group_vxid")


_AUDIT = "select group_vxid, xid, outcome, no_timestamp, truncated, key_overflows, vsl_err, len_hi, key_hi from aud"


def _audit(log, tx, options):
    return U.audit(log, tx, options, _fallback()).select("group_vxid", "xid", "outcome", "no_timestamp", "truncated", "key_overflows", "vsl_err", "len_hi", "key_hi")


@query(sql.with_(sql.audit("doc", TrackOptions(max_reclen=8192), "doc"), then=_AUDIT))
def overflow_discard(spark, sf_dir):
    log = views.document_log(spark, sf_dir)
    return _audit(log, log, TrackOptions(max_reclen=8192))


@query(sql.with_(sql.audit("rec", sql.SMALL, "tx"), then=_AUDIT))
def key_limits(spark, sf_dir):
    return _audit(views.stored_log(spark, sf_dir), views.stored_transactions(spark, sf_dir), sql.SMALL)


@query(sql.with_(sql.audit("rec", TrackOptions(), "tx"), then=_AUDIT))
def audit_groups(spark, sf_dir):
    return _audit(views.stored_log(spark, sf_dir), views.stored_transactions(spark, sf_dir), TrackOptions())


@query(sql.with_(sql.audit("rec", sql.SMALL, "tx"), then=sql.COUNTERS))
def reader_counters(spark, sf_dir):
    return U.reader_counters(U.audit(views.stored_log(spark, sf_dir), views.stored_transactions(spark, sf_dir), sql.SMALL, _fallback()))


@query(sql.with_(_STATES, sql.ROUTED, then="select * from routed"))
def route_partition(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(sql.with_(_STATES, sql.ROUTED, then="select group_vxid, key, reject_reason, case when partition in (select r_regionkey from region where r_regionkey % 2 = 0) then partition end as partition from routed"))
def route_available(spark, sf_dir):
    up = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("partition"), (F.col("r_regionkey") % 2 == 0).alias("available"))
    messages = _messages(spark, sf_dir).select("group_vxid", "key", F.col("data").alias("value"))
    return R.route(messages, TrackOptions(), up).select("group_vxid", "key", "reject_reason", "partition")


@query(sql.with_(_STATES, sql.ROUTED, then="select group_vxid, key, reject_reason, case reject_reason when 'nokey' then 'message shard key is missing' else 'message shard key is not hex' end as reject_text, value from routed where reject_reason is not null"))
def rejects(spark, sf_dir):
    return R.reject_messages(_routed(spark, sf_dir), TrackOptions(log_error_data=True)).select("group_vxid", "key", "reject_reason", "reject_text", "value")


_VALUE = "case when group_vxid // 64 % 5 = 0 then null when group_vxid // 64 % 7 = 0 then '' else data end"
_TEXT = "case reject_reason when 'nodata' then 'message payload is empty' when 'nokey' then 'message shard key is missing' else 'message shard key is not hex' end"


def _holey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which a fifth has no payload and a seventh an empty one."""
    number = F.expr("group_vxid div 64")
    value = F.when(number % 5 != 0, F.when(number % 7 == 0, "").otherwise(F.col("data")))
    return _messages(spark, sf_dir).select("group_vxid", "key", value.alias("value"))


_HOLEY = f"""hol as (select group_vxid, case when reject is null then substr(key, 1, 8) else key end as key, value, reject as reject_reason,
  case when reject is null then cast(cast('0x' || substr(key, 1, 8) as ubigint) % 3 as int) end as partition
  from (select *, case when coalesce(value, '') = '' then 'nodata' when key = '' then 'nokey' when not regexp_full_match(substr(key, 1, 8), '[0-9A-Fa-f]{{1,8}}') then 'badkey' end as reject
        from (select group_vxid, key, {_VALUE} as value from msg) v) m)"""


@query(sql.with_(_STATES, _HOLEY, then="select * from hol"))
def route_payloads(spark, sf_dir):
    """Three partitions, and messages without payload."""
    return R.route(_holey(spark, sf_dir), TrackOptions(num_partitions=3))


@query(sql.with_(_STATES, _HOLEY, then=f"select group_vxid, key, reject_reason, {_TEXT} as reject_text, cast(null as varchar) as value from hol where reject_reason is not null"))
def reject_texts(spark, sf_dir):
    return R.reject_messages(R.route(_holey(spark, sf_dir), TrackOptions(num_partitions=3))).select("group_vxid", "key", "reject_reason", "reject_text", "value")


@query(sql.with_(_STATES, _HOLEY, then="select 'tracks' as topic, key, value, partition from hol where reject_reason is null"))
def topic_rows(spark, sf_dir):
    """What a broker gets."""
    options = TrackOptions(topic="tracks", num_partitions=3)
    return sinks.topic_rows(R.route(_holey(spark, sf_dir), options), options)


@query(sql.with_(_STATES, sql.ROUTED, then="select concat('w', cast(group_vxid // 64 % 20 as varchar)) as worker, count(*) as seen, count(*) filter (where reject_reason is null) as produced, count(*) filter (where reject_reason = 'nokey') as nokey, count(*) filter (where reject_reason = 'badkey') as badkey, count(*) filter (where reject_reason = 'nodata') as nodata from routed group by rollup (1)"))
def sink_stats_rollup(spark, sf_dir):
    worker = F.concat(F.lit("w"), (F.expr("group_vxid div 64") % 20).cast("string"))
    return metrics.sink_counters(_routed(spark, sf_dir).withColumn("worker", worker))


@query(sql.with_(_STATES, then="select concat('key=', key, ': ', data) as value from msg"))
def file_lines(spark, sf_dir):
    return sinks.sink_lines(_messages(spark, sf_dir))


@query(sql.with_(_STATES, then="select key, data from msg"))
def file_roundtrip(spark, sf_dir):
    path = new_path(spark, "messages")
    sinks.write_file(_messages(spark, sf_dir), path)
    return logs.read_sink_lines(spark, path)


@query(sql.with_(_STATES, sql.ROUTED, then="select key, value as data, partition from routed where reject_reason is null"))
def file_partitioned(spark, sf_dir):
    path = new_path(spark, "partitioned")
    sinks.write_file(R.split_rejects(_routed(spark, sf_dir))[0].withColumnRenamed("value", "data"), path, partition_by="partition")
    return logs.read_sink_lines(spark, path)


@query(sql.with_(then="select group_vxid, vxid, tx_seq, rec_seq, tag, payload from rec"))
def log_scan(spark, sf_dir):
    return views.stored_log(spark, sf_dir).select("group_vxid", "vxid", "tx_seq", "rec_seq", "tag", "payload")


@query(sql.with_(then="select group_vxid, vxid, parent_vxid, tx_type, side, tx_seq, rec_seq, tag, payload from rec where (group_vxid // 64) % 50 <> 0"))
def json_log_scan(spark, sf_dir):
    """The log as a broker topic carries it, a fiftieth of the texts broken."""
    text = F.to_json(F.struct("*"))
    lines = views.stored_log(spark, sf_dir).select(F.when(F.expr("group_vxid div 64") % 50 == 0, F.lit("{")).otherwise(text).alias("value"))
    return logs.from_json_lines(lines).drop("ts")


@query(sql.with_(then="select vxid, case side when 'c' then 'request' else 'bereq' end as tx_type, case side when 'c' then 1 else 2 end as depth, row_number() over (partition by vxid, side order by rec_seq) as rec_seq, tag, payload from rec"))
def text_log_scan(spark, sf_dir):
    """Writes the log as text paragraphs, backend requests one level below, and scans it."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_seq", "tag", "payload"))), lambda r: F.concat(F.lit("-   "), r["tag"], F.lit("   "), r["payload"])), "\n")
    text = views.stored_log(spark, sf_dir).groupBy("vxid", "side").agg(lines.alias("lines"))
    head = F.when(F.col("side") == "c", "*   << Request  >> ").otherwise("**  << BeReq    >> ")
    path = new_path(spark, "text-log")
    text.select(F.concat(head, F.col("vxid").cast("string"), F.lit("\n"), "lines").alias("value")).write.option("lineSep", "\n\n").text(path)
    return logs.read_text_log(spark, path)


#: Rows of a file of text, at most, as a compressed one is read in one task.
TEXT_ROWS = 200_000


def _write_text(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "lz4").option("maxRecordsPerFile", TEXT_ROWS).text(path)


def _request_text(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    """The log as text, a row per request: its own paragraph and those of its subrequests, or of each transaction a paragraph alone.

    The third subrequest and those after it stand each below the one before, a backend request below its request.
    """
    depth = F.when(F.col("tx_seq") <= 3, F.least(F.col("tx_seq"), F.lit(1))).otherwise(F.col("tx_seq") - 2) + 1
    log = views.stored_log(spark, sf_dir).withColumn("depth", depth + F.when(F.col("side") == "b", 1).otherwise(0) if nested else F.lit(1))
    mark = lambda c: F.when(F.col("depth") > 3, F.concat(F.lit(c), F.col("depth").cast("string"), F.lit(c if c == "*" else ""), F.lit(" "))).otherwise(F.rpad(F.repeat(F.lit(c), F.col("depth")), 4, " "))
    kind = F.when(F.col("side") == "c", "Request ").otherwise("BeReq   ")
    record = F.struct("rec_seq", F.concat(mark("-"), F.rpad("tag", 14, " "), F.lit(" "), "payload").alias("line"))
    begin = F.concat(F.lit("-   Begin          "), F.when(F.col("side") == "b", F.concat(F.lit("bereq "), F.col("vxid").cast("string"), F.lit(" fetch"))).when(F.col("parent_vxid").isNull(), "req 1 rxreq").otherwise(F.concat(F.lit("req "), F.col("parent_vxid").cast("string"), F.lit(" esi"))))
    head = F.concat(mark("*"), F.lit("<< "), kind, F.lit(" >> "), F.rpad(F.col("vxid").cast("string"), 10, " "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda r: r["line"]), "\n")
    # dealt by group, records serve both groupings: texts are not shuffled again
    dealt = log.repartition("group_vxid") if nested else log
    transactions = dealt.groupBy("group_vxid", "vxid", "parent_vxid", "side", "tx_seq", "depth").agg(lines.alias("lines"))
    text = F.concat(head, F.lit("\n"), *([] if nested else [begin, F.lit("\n")]), F.col("lines"), F.lit("\n"))
    if not nested:
        return transactions.select(text.alias("value"))
    parts = transactions.groupBy("group_vxid").agg(F.array_sort(F.collect_list(F.struct("tx_seq", "depth", text.alias("text")))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("value"))


_TEXT_RECORDS = "select group_vxid, vxid, case side when 'b' then vxid else parent_vxid end as parent_vxid, tx_type, side, row_number() over (partition by vxid, side order by rec_seq) - 1 as rec_seq, tag, payload from rec"


@query(sql.with_(then=_TEXT_RECORDS))
def text_request_log(spark, sf_dir):
    """A dump grouped by request, read back: the nesting gives group, parent and side."""
    path = new_path(spark, "request-text")
    _write_text(_request_text(spark, sf_dir, nested=True), path)
    return logs.read_request_log(spark, path).select("group_vxid", "vxid", "parent_vxid", "tx_type", "side", "rec_seq", "tag", "payload")


@query(sql.with_(_STATES, then=sql.MESSAGES))
def text_log_assemble(spark, sf_dir):
    """Messages of a text dump: those of the table."""
    path = new_path(spark, "request-text")
    _write_text(_request_text(spark, sf_dir, nested=True), path)
    return A.assemble(logs.read_request_log(spark, path), TrackOptions(), _fallback())


@query(sql.with_(_STATES, then=sql.MESSAGES))
def text_log_resolved(spark, sf_dir):
    """A dump of transactions without nesting: groups come from the parents that `Begin` names, their order from the vxids."""
    path = new_path(spark, "flat-text")
    _write_text(_request_text(spark, sf_dir, nested=False), path)
    log = materialize(logs.nested_by_begin(logs.read_request_log(spark, path)).where("side = 'c' and tag <> 'Begin'"), "nested", "zstd")
    tx = groups.resolve_groups(log.select("group_vxid", "vxid", "parent_vxid").distinct()).select("vxid", "group_vxid")
    placed = log.drop("group_vxid").join(tx, "vxid").withColumn("tx_seq", (F.col("vxid") - F.col("group_vxid")).cast("int"))
    return A.assemble(placed, TrackOptions(), _fallback())


@query(sql.with_(_STATES, then="select substr(key, 1, 8) as key, split_part(data, ':', 1) as data from msg"))
def key_data_lines(spark, sf_dir):
    path = new_path(spark, "key-data")
    _messages(spark, sf_dir).select(F.concat("key", F.lit(":"), "data").alias("value")).write.text(path)
    return logs.read_key_data(spark, path, workers=4)


@query(sql.with_(then="select xid, case when status = 'failed' then 'pending' else status end as delivery_status from ev"))
def delivery_reconcile(spark, sf_dir):
    ev = views.deliveries(spark, sf_dir)
    return metrics.reconcile(ev.select("xid"), ev.where("status <> 'failed'").select("xid", "status"))[0]


@query(sql.with_(then="select xid from ev where status = 'failed'"))
def delivery_pending(spark, sf_dir):
    ev = views.deliveries(spark, sf_dir)
    return metrics.reconcile(ev.select("xid"), ev.where("status <> 'failed'").select("xid", "status"))[1]


@query(sql.with_(then="select worker, count(*) as seen, count(*) filter (where status in ('sent', 'reconnect')) as sent, cast(coalesce(sum(bytes) filter (where status in ('sent', 'reconnect')), 0) as bigint) as bytes, count(*) filter (where status = 'reconnect') as reconnects, count(*) filter (where status = 'recoverable') as failed_recoverable, count(*) filter (where status = 'failed') as failed from ev group by worker"))
def worker_counters(spark, sf_dir):
    return metrics.worker_counters(views.deliveries(spark, sf_dir))


@query(sql.with_(then="select count(*) filter (where status in ('sent', 'reconnect')) as sent, count(*) filter (where status in ('failed', 'recoverable')) as failed, cast(coalesce(sum(bytes) filter (where status in ('sent', 'reconnect')), 0) as bigint) as bytes, count(*) filter (where status = 'reconnect') as reconnects, count(distinct worker) as workers, count(*) filter (where status = 'failed') as restarts from ev"))
def total_counters(spark, sf_dir):
    return metrics.total_counters(views.deliveries(spark, sf_dir))


_STATES_OF = "wrk as (select worker, count(*) filter (where status = 'failed') as n from ev group by worker), fld as (select worker, done_ts, row_number() over (partition by worker order by done_ts) as turn from ev where status = 'failed'), sta as (select wrk.worker, least(n, 2) as restarts, n > 2 as abandoned, done_ts as abandoned_at from wrk left join fld on fld.worker = wrk.worker and turn = 3)"


@query(sql.with_(_STATES_OF, then="select * from sta"))
def worker_states(spark, sf_dir):
    return metrics.worker_states(views.deliveries(spark, sf_dir), TrackOptions(thread_restarts=2))


@query(sql.with_(_STATES_OF, then="select count(*) filter (where not abandoned) as active, count(*) filter (where abandoned) as abandoned, cast(sum(restarts) as bigint) as restarts, bool_and(abandoned) as all_abandoned from sta"))
def pool_counters(spark, sf_dir):
    return metrics.pool_counters(metrics.worker_states(views.deliveries(spark, sf_dir), TrackOptions(thread_restarts=2)))


_KIND = "case event_type when 'error' then 'ioerr' when 'signup' then 'reacquire' when 'view' then 'overrun' else 'closed' end"


@query(f"select {_KIND} as kind, count(*) as n from events group by 1")
def incidents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.expr(_KIND).alias("kind"), F.col("props").alias("detail"))
    return metrics.incident_counts(rows)


@query(sql.with_("per as (select time_bucket(interval '30 seconds', done_ts) as interval_start, count(*) as messages, sum(bytes) as bytes, count(*) filter (where status in ('failed', 'recoverable')) as failed from ev group by 1)", then="select interval_start, messages, cast(bytes as bigint) as bytes, failed, cast(sum(messages) over w as bigint) as total_messages, cast(sum(bytes) over w as bigint) as total_bytes, cast(sum(failed) over w as bigint) as total_failed from per window w as (order by interval_start)"))
def interval_snapshots(spark, sf_dir):
    return metrics.interval_snapshots(views.deliveries(spark, sf_dir))


@query(sql.with_(
    "ch as (select submit_ts as moment, 1 as d, greatest(1, cast(ceil(bytes / 256.0) as bigint)) as c from ev union all select done_ts, -1, -greatest(1, cast(ceil(bytes / 256.0) as bigint)) from ev where done_ts is not null)",
    "run as (select moment, time_bucket(interval '1 hour', moment) as interval_start, sum(d) over w as occ, sum(c) over w as chunks, lead(moment) over (order by moment, d) as nxt from (select moment, sign(d) as k, sum(d) as d, sum(c) as c from ch group by 1, 2) s window w as (order by moment, d))",
    "agg as (select interval_start, arg_max(occ, rn) as occ, max(occ) as top, arg_max(chunks, rn) as chunks, max(chunks) as ctop from (select *, row_number() over (order by moment, nxt nulls last) as rn from run) r group by 1)",
    "lvl as (select *, coalesce(lag(occ) over (order by interval_start), 0) as o0, coalesce(lag(chunks) over (order by interval_start), 0) as c0 from agg)",
    "hi as (select interval_start, cast(occ as bigint) as occ, cast(greatest(top, o0) as bigint) as occ_hi_this, cast(chunks as bigint) as chunks, cast(greatest(ctop, c0) as bigint) as chunks_hi_this from lvl)",
    then="select *, max(occ_hi_this) over w as occ_hi, max(chunks_hi_this) over w as chunks_hi from hi window w as (order by interval_start)",
))
def occupancy(spark, sf_dir):
    return metrics.occupancy(views.deliveries(spark, sf_dir), TrackOptions(monitor_interval=3600))


@query(sql.with_(_STATES, sql.ROUTED, then="select group_vxid, key, partition, row_number() over (partition by partition order by group_vxid) as place from routed where reject_reason is null"))
def ordered_output(spark, sf_dir):
    """Messages in sink order, with their place in the partition's file."""
    rows = R.with_places(R.split_rejects(_routed(spark, sf_dir))[0].select("group_vxid", "key", "partition"))
    return R.ordered(rows).select("group_vxid", "key", "partition", "place")


class SampleWriter:
    """A writer that fails by rule: every 10th message is lost, every 15th breaks the connection, every 45th for good."""

    def open(self):
        self.broken = False

    def send(self, data, key):
        number = int(data.split("&", 1)[0][4:]) // 64
        if self.broken:
            self.broken = False
            return -1 if number % 45 == 0 else 0
        return -1 if number % 15 == 0 else 1 if number % 10 == 0 else 0

    def reconnect(self):
        self.broken = True
        return True

    def close(self):
        pass


_SENT = "case when xid // 64 % 45 = 0 then 'failed' when xid // 64 % 15 = 0 then 'reconnect' when xid // 64 % 10 = 0 then 'recoverable' else 'sent' end"


@query(sql.with_(_STATES, then=f"select xid, {_SENT} as status, cast(octet_length(encode(data)) as int) as bytes from msg"))
def plugin_sink(spark, sf_dir):
    return sinks.write_messages(_messages(spark, sf_dir), SampleWriter)


@query(sql.with_(_STATES, f"del as (select concat('w', cast(xid // 64 % 20 as varchar)) as worker, {_SENT} as status from msg)", then="select worker, count(*) as seen, count(*) filter (where status = 'reconnect') as reconnects, count(*) filter (where status = 'recoverable') as failed_recoverable, count(*) filter (where status = 'failed') as failed from del group by worker"))
def send_retry(spark, sf_dir):
    rows = sinks.write_messages(_messages(spark, sf_dir), SampleWriter).withColumn("worker", F.concat(F.lit("w"), (F.expr("xid div 64") % 20).cast("string")))
    return metrics.worker_counters(rows).select("worker", "seen", "reconnects", "failed_recoverable", "failed")


@query(sql.with_(_STATES, sql.ROUTED, f"rep as (select concat('w', cast(group_vxid // 64 % 20 as varchar)) as worker, reject_reason, case when reject_reason is null then {_SENT.replace('xid', 'group_vxid')} end as status from routed)", then="select worker, count(*) as seen, count(*) filter (where reject_reason is null) as produced, count(*) filter (where status in ('sent', 'reconnect')) as delivered, count(*) filter (where status in ('failed', 'recoverable')) as failed, count(*) filter (where reject_reason = 'nokey') as nokey, count(*) filter (where reject_reason = 'badkey') as badkey, count(*) filter (where reject_reason = 'nodata') as nodata from rep group by rollup (1)"))
def sink_deliveries(spark, sf_dir):
    """Sink counters with the reports of what was delivered."""
    routed = _routed(spark, sf_dir)
    reports = sinks.write_messages(R.split_rejects(routed)[0], SampleWriter, "group_vxid", "value")
    joined, _ = metrics.reconcile(routed, reports, "group_vxid")
    worker = F.concat(F.lit("w"), (F.expr("group_vxid div 64") % 20).cast("string"))
    return metrics.sink_counters(joined.withColumn("worker", worker), status="delivery_status")


@query(sql.with_(_STATES, then="select key, data from msg"))
def sink_format(spark, sf_dir):
    """Messages through the sink's data source and back."""
    plugin.register(spark)
    path = new_path(spark, "sink")
    _messages(spark, sf_dir).select("key", "data").write.format(plugin.FORMAT).mode("append").save(path)
    return spark.read.format(plugin.FORMAT).load(path)

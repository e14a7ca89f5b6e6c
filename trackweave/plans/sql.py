"""DuckDB SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

from ..options import TrackOptions
from .views import FALLBACK_TS, cte

_SECONDS = 1430827200  # FALLBACK_TS


def entries(log: str) -> str:
    return f"""
ent as (
  select group_vxid, vxid, tx_seq, rec_seq, kind, case when kind in ('data', 'key') then case when kind = 'key' then substr(rest, 5) else rest end else '' end as body,
         case when kind = 'time' and ts_s <> '' then cast(ts_s as bigint) end as s, case when kind = 'time' and ts_s <> '' then cast(ts_u as bigint) end as u
  from (select *, case tag when 'VCL_Log' then case when starts_with(rest, 'key ') then 'key' else 'data' end when 'Timestamp' then 'time' else 'error' end as kind from (
    select *, case when tag <> 'VCL_Log' then '' when regexp_matches(substr(payload, 7), '^[0-9]+ .', 's') then substr(substr(payload, 7), instr(substr(payload, 7), ' ') + 1) else substr(payload, 7) end as rest,
      regexp_extract(payload, '^Resp: ([0-9]{{1,10}})\\.([0-9]{{6}}) ', 1) as ts_s, regexp_extract(payload, '^Resp: ([0-9]{{1,10}})\\.([0-9]{{6}}) ', 2) as ts_u
    from {log} where side = 'c' and tx_type = 'req' and ((tag = 'VCL_Log' and payload like 'track %') or (tag = 'Timestamp' and payload like 'Resp%') or tag = 'VSL')) a) b)"""


def states(log: str, options: TrackOptions) -> str:
    """CTEs up to `done`: one row per group with matching records."""
    return f"""{entries(log)},
cut as (select *, split_part(body, chr(0), 1) as cut, instr(body, chr(0)) > 0 as nul from ent),
len as (select *, first_value(vxid) over w as xid,
  4 + length(cast(first_value(vxid) over w as varchar)) + coalesce(sum(case when kind = 'data' then 1 + octet_length(encode(cut)) else 0 end) over b, 0) as end_before
  from cut window w as (partition by group_vxid order by tx_seq, rec_seq), b as (partition by group_vxid order by tx_seq, rec_seq rows between unbounded preceding and 1 preceding)),
ovf as (select *, kind = 'data' and end_before + octet_length(encode(body)) + 1 > {options.max_reclen} as overflow from len),
live as (select * from (select *, coalesce(bool_or(overflow) over (partition by group_vxid order by tx_seq, rec_seq rows between unbounded preceding and 1 preceding), false) as late from ovf) l where not late),
grp as (select group_vxid, arg_min(vxid, (tx_seq, rec_seq)) as xid, bool_or(overflow) as overflow, bool_or(kind = 'data' and not overflow) as has_data,
  string_agg(case when kind = 'data' and not overflow then cut end, '&' order by tx_seq, rec_seq) as text,
  coalesce(arg_max(body, (tx_seq, rec_seq)) filter (where kind = 'key' and octet_length(encode(body)) <= {options.maxkeylen}), '') as key,
  max((s, u)) filter (where s is not null) as time,
  count(*) filter (where kind = 'data' and not overflow and nul) as truncated,
  count(*) filter (where kind = 'key' and octet_length(encode(body)) > {options.maxkeylen}) as key_overflows,
  count(*) filter (where kind = 'error') as vsl_err,
  max(end_before + case when kind = 'data' and not overflow then 1 + octet_length(encode(cut)) else 0 end) as len_end,
  coalesce(max(octet_length(encode(body))) filter (where kind = 'key' and octet_length(encode(body)) <= {options.maxkeylen}), 0) as key_hi
  from live group by group_vxid),
fin as (select *, coalesce(time[1], 0) = 0 as untimed,
  case when overflow or (has_data and len_end + 27 > {options.max_reclen}) then 'len_overflow' when not has_data then 'nodata' else 'submitted' end as outcome from grp),
done as (select *, has_data and not overflow and untimed as no_timestamp, case when untimed then {_SECONDS} else time[1] end as es, case when untimed then 0 else time[2] end as eu from fin),
msg as (select group_vxid, xid, concat('XID=', cast(xid as varchar), '&', text, '&req_endt=', cast(es as varchar), '.', lpad(cast(eu as varchar), 6, '0')) as data, key,
  make_timestamp(cast(es * 1000000 + eu as bigint)) as req_end, no_timestamp from done where outcome = 'submitted')"""


MESSAGES = "select group_vxid, xid, data, octet_length(encode(data)) as data_bytes, key, req_end, no_timestamp from msg"


def with_(*parts: str, then: str) -> str:
    return f"with {', '.join((cte(), *parts))} {then}"


def audit(log: str, options: TrackOptions, groups: str) -> str:
    return f"""{states(log, options)},
aud as (select g.group_vxid, xid, coalesce(outcome, 'nodata') as outcome, coalesce(no_timestamp, false) as no_timestamp, coalesce(truncated, 0) as truncated,
  coalesce(key_overflows, 0) as key_overflows, coalesce(vsl_err, 0) as vsl_err, coalesce(len_end + case when outcome = 'submitted' then 27 else 0 end, 0) as len_hi, coalesce(key_hi, 0) as key_hi
  from (select distinct group_vxid from {groups}) g left join done using (group_vxid))"""


COUNTERS = """select count(*) as seen, count(*) filter (where outcome = 'submitted') as submitted, count(*) filter (where outcome = 'nodata') as nodata, max(len_hi) as len_hi, max(key_hi) as key_hi,
 count(*) filter (where outcome = 'len_overflow') as len_overflows, cast(sum(truncated) as bigint) as truncated, cast(sum(key_overflows) as bigint) as key_overflows, cast(0 as bigint) as vcl_log_err,
 count(*) filter (where no_timestamp) as no_timestamp, cast(sum(vsl_err) as bigint) as vsl_err from aud"""

ROUTED = """routed as (select group_vxid, case when reject is null then substr(key, 1, 8) else key end as key, data as value, reject as reject_reason,
  case when reject is null then cast(cast('0x' || substr(key, 1, 8) as ubigint) % 4 as int) end as partition
  from (select *, case when key = '' then 'nokey' when not regexp_full_match(substr(key, 1, 8), '[0-9A-Fa-f]{1,8}') then 'badkey' end as reject from msg) m)"""

OPTIONS = TrackOptions()
SMALL = TrackOptions(max_reclen=120, maxkeylen=4)
assert FALLBACK_TS == "2015-05-05 12:00:00"

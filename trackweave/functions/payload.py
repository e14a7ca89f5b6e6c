"""Column functions: payloads, times, keys and messages. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A track payload: an optional numeric id that is followed by a blank and more, an optional key mark, the body.
TRACK = r"(?s)\Atrack (?:[0-9]++ (?=.))?(key )?(.*)\z"
RESPONSE_TIME = r"^Resp: ([0-9]{1,10})\.([0-9]{6}) "
#: Bytes that the closing time entry counts for, its `&` included.
TIME_BYTES = 27
KEY_BYTES = 8


def is_key(payload: Column) -> Column:
    return F.regexp_extract(payload, TRACK, 1) != ""


def body(payload: Column) -> Column:
    return F.regexp_extract(payload, TRACK, 2)


def cut_at_nul(value: Column) -> Column:
    return F.substring_index(value, "\0", 1)


def has_nul(value: Column) -> Column:
    return F.instr(value, "\0") > 0


def response_time(payload: Column) -> Column:
    """(s, u) of a response timestamp, null unless there are 1-10 and 6 digits."""
    second = F.regexp_extract(payload, RESPONSE_TIME, 1)
    return F.when(second != "", F.struct(second.cast("long").alias("s"), F.regexp_extract(payload, RESPONSE_TIME, 2).cast("long").alias("u")))


def unsigned_32(value: Column) -> Column:
    """A decimal number of 32 bits without sign; null for anything else."""
    number = value.try_cast("decimal(20,0)")
    return F.when(value.rlike("^[0-9]+$") & (number <= 4294967295), number.cast("long"))


def to_timestamp(time: Column) -> Column:
    return F.timestamp_micros(time["s"] * 1_000_000 + time["u"])


def format_time(time: Column) -> Column:
    return F.format_string("req_endt=%d.%06d", time["s"], time["u"])


def message(xid: Column, data: Column, time: Column) -> Column:
    return F.concat(F.lit("XID="), xid.cast("string"), F.lit("&"), data, F.lit("&"), format_time(time))


def short_key(key: Column) -> Column:
    return F.substring(key, 1, KEY_BYTES)


def is_hex_key(key: Column) -> Column:
    return short_key(key).rlike("^[0-9A-Fa-f]{1,8}$")


def key_number(key: Column) -> Column:
    return F.conv(short_key(key), 16, 10).cast("long")


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a hex key; null for other keys."""
    return F.when(is_hex_key(key), (key_number(key) % partitions).cast("int"))


def sink_line(key: Column, data: Column) -> Column:
    return F.concat(F.lit("key="), F.coalesce(key, F.lit("")), F.lit(": "), data)


def fields(data: Column) -> Column:
    """A message's `name=value` entries as a map, for readers of the sink."""
    return F.str_to_map(data, F.lit("&"), F.lit("="))

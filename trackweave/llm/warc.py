"""WARC archives: write pages as records with revisits and segments, read them back, reassemble.

Writing is done by Spark's text writer: a row is one record and the line separator is the blank lines
between records, so every part file is an archive (gzip is optional). A payload is framed in chunks
as HTTP transfers are; a record block longer than `segment_chars` is written as a first segment and
continuation records. Reading cuts the archives where a record may begin, so a task holds a record and
not an archive, and takes blocks by their Content-Length; it groups continuation records by the
origin's record id, orders them by segment number, verifies that numbers are complete and that the
length is the stated total, and decodes the chunked framing.

Of pages with equal payloads of at least `least_bytes` bytes the one with the smallest id is written
in full; the others refer to it. Groups of any size are found by hash with map-side aggregation.

Defined results: a null html is an empty payload; control characters in a URL are escaped; repeated
rows (one id and payload) are a record each, all but one with a number of their own in the record id; a
null id is written as an empty one and read as null, and a page with one gives no page it refers to; an
empty table gives empty archives and an empty result; other columns are not looked at. A record that
ends early, a missing segment, a wrong total length or a digest that does not match stop the job. Lines
of headers end with CR LF. A payload may hold the line that begins a record; in an archive that is not
compressed and is read in several splits such a payload can stop the job, compressed ones are never split.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, number_rows

CRLF = "\r\n"
LEAST_BYTES = 100
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
RECORDS_PER_FILE = 5_000
#: Rows of one digest are dealt to so many tasks.
SALTS = 16
_URN = "urn:page:"
_HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])

RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, segment_number int, origin_id string, total_length long, block binary"


def _pieces(text: Column, chars: int) -> Column:
    long = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(F.octet_length(text) > chars, long).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def _chunked(payload: Column, chars: int) -> Column:
    framed = F.transform(_pieces(payload, chars), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(CRLF), x, F.lit(CRLF)))
    return F.concat(F.lit(_HTTP), F.array_join(framed, ""), F.lit("0" + CRLF * 2))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(CRLF))


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with `again`: a number of its own for each of the repeated rows but one of a key and digest, else null."""
    marked = rows.join(repeated.withColumn("repeated", F.lit(True)), ["key", "digest"], "left")
    many = number_rows(marked.where("repeated").withColumn("_salt", F.rand(5)), [F.col("digest"), F.col("key"), F.col("_salt")], "number")
    leads = many.groupBy("digest", "key").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("lead"))
    many = many.join(leads, "number", "left").withColumn("again", F.when(F.col("lead").isNull(), F.col("number").cast("long")))
    once = marked.where("repeated is null").withColumn("again", F.lit(None).cast("long"))
    return once.select(*rows.columns, "again").unionByName(many.select(*rows.columns, "again"))


def to_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int, segment_chars: int, chunk_chars: int) -> DataFrame:
    """One row per WARC record, its text in `value`."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    keys = materialize(rows.groupBy("key", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("bytes")), "page-keys")
    copies = keys.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = keys.where("n > 1").select("key", "digest")
    rows = rows.withColumn("again", F.lit(None).cast("long")) if repeated.first() is None else _numbered(rows, repeated)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    rows = rows.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left").drop("salt")
    urn = lambda name, number: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(":"), F.col("digest"), number, F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(
        urn("id", F.coalesce(F.concat(F.lit("/"), "again"), F.lit(""))).alias("record_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        "digest",
        F.when(revisit, urn("first", F.lit(""))).alias("refers_to"),
        F.when(revisit, F.array(F.lit(""))).otherwise(_pieces(_chunked(F.col("payload"), chunk_chars), segment_chars)).alias("blocks"),
    )
    rows = rows.select("record_id", "url", "digest", "refers_to", F.size("blocks").alias("segments"), F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)).alias("total"), F.posexplode("blocks").alias("at", "block"))
    first, many = F.col("at") == 0, F.col("segments") > 1
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(first, "response").otherwise("continuation")
    header = _header(
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(F.concat(F.expr("substring(record_id, 1, length(record_id) - 1)"), F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), "digest"))),
        ("WARC-Profile", F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Segment-Number", F.when(many, F.col("at") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("at") + 1 == F.col("segments")), F.col("total"))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length("block")),
    )
    return rows.select(F.concat(header, "block").alias("value"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    segment_chars: int = SEGMENT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    records_per_file: int = RECORDS_PER_FILE,
    compression: str = "gzip",
) -> None:
    """Write pages as WARC archives, one per part file of at most `records_per_file` records."""
    records = to_records(pages, id_col, url_col, html_col, least_bytes, segment_chars, chunk_chars)
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


_BEGIN = b"\r\nWARC/1."


def parse_records(pieces: Iterable[bytes | memoryview]) -> Iterator[dict]:
    """The records of one archive, cut at every `_BEGIN`; a cut inside a block is mended by its Content-Length."""
    fields, parts, missing, begun = {}, [], 0, b""
    for piece in pieces:
        if missing:
            parts += [_BEGIN, bytes(piece)]
            missing -= len(_BEGIN) + len(piece)
        else:
            begun += bytes(piece) if begun else bytes(piece).removeprefix(_BEGIN[2:])
            head, found, block = begun.partition(b"\r\n\r\n")
            if not found and begun[1:3] == b"\r\n":  # the block itself begins like a record
                begun += _BEGIN
                continue
            if not found or head[1:3] != b"\r\n":
                raise ValueError(f"no WARC record begins with {head[:40]!r}")
            begun = b""
            fields = {}
            for line in head.decode().split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            parts, missing = [block], int(fields["content-length"]) - len(block)
        if missing > 0:
            continue
        block, missing = b"".join(parts), 0
        size = int(fields["content-length"])
        if block[size:].strip(b"\r\n"):
            raise ValueError(f"a WARC block is longer than its {size} bytes")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "record_id": fields.get("warc-record-id"),
            "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest"),
            "refers_to": fields.get("warc-refers-to"),
            "segment_number": int(number) if number else None,
            "origin_id": fields.get("warc-segment-origin-id"),
            "total_length": int(total) if total else None,
            "block": block[:size],
        }
    if missing or begun:
        raise ValueError("a WARC record ends early")


def _record_schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[memoryview]]:
    """The pieces of each file; a task reads its files one after the other."""
    rows = ((file, piece.as_buffer()) for batch in batches for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for _, own in itertools.groupby(rows, key=lambda x: x[0]):
        yield (piece for _, piece in own)


def read_warc(spark: SparkSession, path: str, decoded: bool = False, batch_bytes: int = 1 << 22) -> DataFrame:
    """The records of all archives under a path, one row each (see RECORDS).

    With `decoded`, unsegmented responses have payload_bytes and a verified payload_digest in place of
    their block, so only segments carry bytes on.
    """
    fields = RECORDS + ", payload_bytes long" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, size = _record_schema(fields), [], 0
        for pieces in _archives(batches):
            for record in parse_records(pieces):
                if decoded and record["segment_number"] is None:
                    block = record.pop("block")
                    if record["record_type"] == "response":
                        payload = decode_http(block)
                        record |= {"payload_bytes": len(payload), "payload_digest": _verified(payload, record["payload_digest"])}
                rows.append(record)
                size += len(record.get("block", b"")) + 300
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = spark.read.option("lineSep", _BEGIN.decode()).text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, fields)


def _verified(payload: bytes, stated: str | None) -> str:
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    if stated is not None and stated != digest:
        raise ValueError(f"a payload does not match its digest {stated}")
    return digest


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: record_id, record_type, target_uri, payload_digest, refers_to, blocks (in segment order).

    Only segmented records are shuffled. A segment that occurs twice counts once.
    """
    own = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to"]
    single = records.where("segment_number is null").select(*own, F.array("block").alias("blocks"))
    parts = records.where("segment_number is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    head = F.max(F.when(F.col("segment_number") == 1, F.struct(*own)))
    grouped = parts.groupBy("origin").agg(head.alias("head"), F.max("total_length").alias("total"), F.array_sort(F.collect_set(F.struct("segment_number", "block"))).alias("parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    numbers = F.transform("parts", lambda x: x["segment_number"])
    whole = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (size == F.col("total"))
    blocks = F.when(F.coalesce(whole, F.lit(False)), F.transform("parts", lambda x: x["block"])).otherwise(F.raise_error(F.concat(F.lit("segments are missing or have a wrong total length: "), "origin")))
    return single.unionByName(grouped.select("head.*", blocks.alias("blocks")))


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not have its stated length")
        at = end + 4 + size


def payloads(whole: DataFrame) -> DataFrame:
    """Responses with their payload and its verified digest: record_id, target_uri, payload, payload_bytes, payload_digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_http(b"".join(x.as_py())) for x in batch.column(3)]
            digests = [_verified(x, stated) for x, stated in zip(found, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(map(len, found), pa.int64()), pa.array(digests, pa.string())], names=["record_id", "target_uri", "payload", "payload_bytes", "payload_digest"])

    rows = whole.where("record_type = 'response'").select("record_id", "target_uri", "payload_digest", "blocks")
    return rows.mapInArrow(run, "record_id string, target_uri string, payload binary, payload_bytes long, payload_digest string")


def page_id(record_id: str, kind: str) -> Column:
    """The page's id in a record id that write_warc made."""
    return F.regexp_extract(record_id, rf"^<{_URN}(.*):[0-9a-f]{{64}}(?:/[0-9]+)?>$", 1).try_cast(kind)


def page_records(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """What archives of write_warc hold, per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = materialize(read_warc(spark, path, decoded=True), "records")
    bare = lambda digest: F.regexp_replace(digest, "^sha256:", "").alias("payload_digest")
    single = records.where("segment_number is null and record_type = 'response'").select("record_id", "payload_bytes", bare("payload_digest"))
    joined = payloads(reassemble(records.where("segment_number is not null"))).select("record_id", "payload_bytes", bare("payload_digest"))
    done = materialize(single.unionByName(joined), "payloads")
    revisits = records.where("segment_number is null and record_type = 'revisit'").select("record_id", bare("payload_digest"), "refers_to")
    lengths = done.select(F.col("record_id").alias("refers_to"), "payload_bytes").dropDuplicates(["refers_to"])
    rows = done.select("record_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    rows = rows.unionByName(revisits.join(lengths, "refers_to", "left").withColumn("record_type", F.lit("revisit")))
    own = page_id("record_id", kind)
    return rows.select(own.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(own.isNotNull(), page_id("refers_to", kind)).alias("refers_to"))


ORACLE = """
select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from (select page_id, h, case when octet_length(encode(h)) >= 100 then min(page_id) over (partition by h) end as first from (select page_id, coalesce(html, '') as h from pages) p) q
"""

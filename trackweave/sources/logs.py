"""Log sources: tables, text logs, sink files and key:data lines; batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LOG_RECORD


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log table."""
    return spark.read.schema(LOG_RECORD).parquet(path)


def tail_log(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The log as a stream of files; with the `availableNow` trigger it is a bounded replay."""
    return spark.readStream.schema(LOG_RECORD).option("maxFilesPerTrigger", max_files).parquet(path)


def topic_source(topic: str, servers: str, tail: bool = True, **client: str) -> dict[str, str]:
    """Options to read a log from a broker: from now on, or from the start. Lost ranges are passed over, as after an overrun."""
    own = {"subscribe": topic, "kafka.bootstrap.servers": servers, "startingOffsets": "latest" if tail else "earliest", "failOnDataLoss": "false"}
    return own | {f"kafka.{k}": v for k, v in client.items()}


def tail_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A log of JSON records on a broker topic as a stream; needs Spark's Kafka package. A restart goes on from its checkpoint."""
    return from_json_lines(spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value")))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Log records from JSON texts in `value`; texts that are no records are dropped."""
    record = F.from_json("value", LOG_RECORD)
    return lines.select(record.alias("r")).where("r.tag is not null").select("r.*")


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """Text dumps of one paragraph per transaction: vxid, tx_type, depth, rec_seq, tag, payload.

    A paragraph begins with `*   << Request  >> 591570` (more stars for deeper levels) and has one
    record a line, `-   Tag   payload`. Paragraphs are divided by blank lines, so files split.
    """
    head = r"^(\*+)\s+<<\s*(\w+)\s*>>\s+(\d+)"
    paragraph = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    lines = paragraph.select(F.split("value", "\n").alias("lines"))
    first = F.element_at("lines", 1)
    rows = lines.select(
        F.regexp_extract(first, head, 3).try_cast("long").alias("vxid"),
        F.lower(F.regexp_extract(first, head, 2)).alias("tx_type"),
        F.length(F.regexp_extract(first, head, 1)).alias("depth"),
        F.posexplode("lines").alias("rec_seq", "line"),
    )
    record = r"(?s)^-+\s+(\S+)(?:\s+(.*))?$"
    rows = rows.where("rec_seq > 0").select("vxid", "tx_type", "depth", "rec_seq", F.regexp_extract("line", record, 1).alias("tag"), F.regexp_extract("line", record, 2).alias("payload"))
    return rows.where("tag <> '' and vxid is not null")


#: A transaction's head: its level as stars, from the fourth on as a number between two; its kind; its vxid.
_HEAD = r"^(?:\*([0-9]+)\*|(\*+))\s*<<\s*(\w+)\s*>>\s*([0-9]+)"
#: A record: marks for the level, tag, payload.
_LINE = r"(?s)^-[-0-9]*\s+(\S+)(?:[ \t]+(.*))?$"
_ROOT = "*   <<"


def _transactions(heads: Column) -> Column:
    """Heads in order, each with the transaction that it stands below: a stack of one vxid a level, folded over them.

    A level that skips some stands below the deepest one open.
    """
    start = F.struct(F.array().cast("array<long>").alias("stack"), F.array().cast("array<struct<vxid:long,parent:long,kind:string,place:int,root:long>>").alias("done"))

    def step(state: Column, head: Column) -> Column:
        above = F.slice(state["stack"], 1, F.least(F.greatest(head["depth"] - 1, F.lit(0)), F.size(state["stack"])))
        own = F.struct(head["vxid"].alias("vxid"), F.get(above, F.size(above) - 1).alias("parent"), head["kind"].alias("kind"), head["place"].alias("place"), F.coalesce(F.get(above, F.lit(0)), head["vxid"]).alias("root"))
        return F.struct(F.concat(above, F.array(head["vxid"])).alias("stack"), F.concat(state["done"], F.array(own)).alias("done"))

    return F.aggregate(heads, start, step, lambda state: state["done"])


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Text dumps grouped by request as a log table, ready to assemble (times are null).

    A request is a paragraph that begins with `*   << Request  >> 591570` and goes on with those of its
    subrequests, one level deeper each, up to the next such head. Files are cut there, so a row holds one whole request
    and large files split. The nesting gives parent and group, the kind gives side and
    type, `tx_seq` is the order of paragraphs in the request and `rec_seq` that of records in a paragraph.

    Blank lines and lines that are neither heads nor records are left out, and so are records before the first head.
    Dumps without nesting name the parent in the `Begin` record: they are read with `nested_by_begin`.
    """
    text = spark.read.option("lineSep", f"\n{_ROOT}").text(path).where("value <> ''")
    whole = F.when(F.startswith("value", F.lit("*")), F.col("value")).otherwise(F.concat(F.lit(_ROOT), "value"))
    lines = text.select(F.split(whole, "\r?\n").alias("lines"))
    places = F.transform("lines", lambda line, i: F.struct(line.alias("line"), i.alias("place")))
    depth = lambda line: F.when(F.regexp_extract(line, _HEAD, 1) != "", F.regexp_extract(line, _HEAD, 1).try_cast("int")).otherwise(F.length(F.regexp_extract(line, _HEAD, 2)))
    heads = F.transform(
        F.filter(places, lambda p: p["line"].rlike(_HEAD)),
        lambda p: F.struct(depth(p["line"]).alias("depth"), F.lower(F.regexp_extract(p["line"], _HEAD, 3)).alias("kind"), F.regexp_extract(p["line"], _HEAD, 4).try_cast("long").alias("vxid"), p["place"].alias("place")),
    )
    placed = lines.select("lines", _transactions(heads).alias("heads"))
    each = placed.select("lines", F.size("heads").alias("n"), F.posexplode("heads").alias("tx_seq", "t"), "heads")
    until = F.coalesce(F.get("heads", F.col("tx_seq") + 1)["place"], F.size("lines"))
    own = each.select("tx_seq", "t", F.slice("lines", F.col("t.place") + 2, F.greatest(until - F.col("t.place") - 1, F.lit(0))).alias("own"))
    rows = own.select("tx_seq", "t", F.posexplode("own").alias("rec_seq", "line")).where(F.col("line").rlike(_LINE))
    kind = F.col("t.kind")
    return rows.select(
        F.col("t.root").alias("group_vxid"),
        F.col("t.vxid").alias("vxid"),
        F.col("t.parent").alias("parent_vxid"),
        F.when(kind == "request", "req").otherwise(kind).alias("tx_type"),
        F.when(kind == "request", "c").when(kind == "bereq", "b").alias("side"),
        F.col("tx_seq").cast("int").alias("tx_seq"),
        F.col("rec_seq").cast("int").alias("rec_seq"),
        F.regexp_extract("line", _LINE, 1).alias("tag"),
        F.regexp_extract("line", _LINE, 2).alias("payload"),
        F.lit(None).cast("timestamp").alias("ts"),
    )


def nested_by_begin(log: DataFrame) -> DataFrame:
    """A log of transactions that stand alone, with the parents that `Begin` records name: group unset, to be resolved.

    The payload is `<kind> <parent> <reason>`; a parent counts if the reason is that of a subrequest (`esi` or `fetch`).
    """
    begin = r"^(?:req|bereq)\s+([0-9]+)\s+(?:esi|fetch)\b"
    own = Window.partitionBy("vxid", "tx_type")
    parent = F.max(F.when(F.col("tag") == "Begin", F.regexp_extract("payload", begin, 1).try_cast("long"))).over(own)
    return log.withColumns({"parent_vxid": F.coalesce("parent_vxid", parent), "group_vxid": F.lit(None).cast("long")}).select(*log.columns)


def read_sink_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the file sink as key and data, and the column of the folders where there are any."""
    pattern = r"(?s)^key=(.*?): (.*)$"
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    return lines.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("data"), *folders)


def read_key_data(spark: SparkSession, path: str, workers: int = 1) -> DataFrame:
    """`key:data` lines up to a file's first empty one; what follows a second colon is dropped; keys are cut to 8 bytes."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    stop = lines.where("value = ''").groupBy("file").agg(F.min("place").alias("stop"))
    kept = lines.join(stop, "file", "left").where("stop is null or place < stop")
    part = F.split("value", ":")
    return kept.select(F.substring(F.get(part, F.lit(0)), 1, 8).alias("key"), F.get(part, F.lit(1)).alias("data")).repartition(workers)

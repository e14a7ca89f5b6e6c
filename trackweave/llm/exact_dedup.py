"""Exact deduplication by content hash, in DataFrame operations only.

Texts are grouped by a 128-bit content hash (MD5) *and* by their bytes: the grouping compares the
bytes of texts whose hashes agree, so texts that collide stay apart. Spark combines equal texts
before the shuffle, which keeps a group of any number of copies as small as one row per map task.

Defined results: a null text counts as empty and equals an empty one; with `keep="max"` (or "min")
the row with the largest (smallest) id of a group stays; repeated rows with one id count as copies
and are marked alike; null ids lose against all others, and a group of null ids only has a null
`keep_id` and its rows are kept; an empty table gives an empty result; other columns of the input,
whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per distinct text: hash, text, keep_id, group_size."""
    chosen = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text"))
    return rows.groupBy(_hash(F.col("text")).alias("hash"), "text").agg(chosen("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Distinct texts under one MD5 are told apart by their SHA-256 when documents look up their
    group; should both ever agree for different bytes, the job stops instead of merging them.
    """
    sha = F.sha2(F.col("text"), 256)
    groups = (
        text_classes(docs, id_col, text_col, keep)
        .filter("group_size > 1")
        .groupBy("hash", F.unhex(sha).alias("sha"))
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256"))))
        .drop("texts")
    )
    rows = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text"))
    rows = rows.select("id", _hash(F.col("text")).alias("hash"), F.unhex(sha).alias("sha"))
    single = F.col("group_size").isNull()
    return rows.join(groups, ["hash", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, one row per distinct text, with all their columns.

    The row itself travels through the grouping as the smallest (largest) of its group by id, so
    no second pass over the texts is needed. Among rows with one id the smallest (largest) by the
    remaining columns stays.
    """
    chosen = {"min": F.min, "max": F.max}[keep]
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("no_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    if keep == "max":
        row = row.withField("no_id", ~F.col(id_col).isNull())
    groups = docs.select(_text(text_col).alias("text"), row.alias("row")).groupBy(_hash(F.col("text")).alias("hash"), "text").agg(chosen("row").alias("row"))
    out = {id_col: F.col("row.id"), text_col: F.when(~F.col("row.no_text"), F.col("text"))} | {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    return groups.select(*[out[c].alias(c) for c in docs.columns])


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
"""

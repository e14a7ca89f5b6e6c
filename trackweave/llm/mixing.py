"""Mixing sources to target weights, in DataFrame operations only.

Targets come from capped water-filling: every source gets a share of the total in proportion to
its weight; sources above `max_epochs` times their own size are clamped there and the excess is
shared among the others by weight, until none is above. Documents are then repeated a whole number
of times, and a seeded selection of each source once more, until the source's target is met to the
word: the one document at the cut is taken in part.

The selection follows a seeded hash of the id. Sizes are summed by source and hash bucket first, so
running totals are over buckets; only the bucket at the cut of each source is ordered row by row.
A source with a third of all rows is spread over all its buckets in every shuffle.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source
of its own, numbered last; a source of size 0 has target 0; repeated rows each count; an empty table
gives an empty result; other columns are not looked at. Ids that are null share one place in the
selection order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, number_rows

BUCKETS = 4096
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, 0 for null: each word shrinks to its first character, so no array of words is built."""
    firsts = F.regexp_replace(text, r"[\x20\x09-\x0D]*+([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++", "$1")
    return F.coalesce(F.length(firsts), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add `target` to sources(weight, source_size): the fixed point of clamp-and-reshare.

    Each round reads three sums over the source table; the level only rises, so a source once
    clamped stays so and there are at most as many rounds as sources, in practice a few.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(above, cap)).alias("caps"), F.sum(F.when(~above, F.col("weight"))).alias("weights"), F.count_if(above).alias("n")).first()
        if row.n == clamped or not row.weights:
            level = float("inf") if level is not None and not row.weights else level or 0.0
            break
        clamped, level = row.n, (total - (row.caps or 0.0)) / row.weights
    share = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", share.cast("double"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats (whole), part (words of one more), taken."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    rows = materialize(rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS), "mix-sizes")
    hist = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    sources = hist.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = number_rows(sources, [F.col("source").asc_nulls_last()], "place")
    sources = materialize(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))), "mix-sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    sources = fill_targets(sources, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("repeats") * F.col("source_size")
    sources = sources.withColumn("repeats", whole).withColumn("rest", rest).withColumnRenamed("source", "own")
    before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
    cuts = hist.withColumn("before", before).withColumnRenamed("size", "bucket_size")
    cuts = cuts.join(sources, F.col("source").eqNullSafe(F.col("own"))).select(F.col("source").alias("own"), F.col("bucket").alias("own_bucket"), "before", "bucket_size", "source_size", "target", "repeats", "rest")
    dealt = rows.join(cuts, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("own_bucket")))
    at_cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = dealt.filter(at_cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - upto)))
    others = dealt.filter(~at_cut).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0))
    return cut.unionByName(others).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "repeats",
        F.col("part").cast("long").alias("part"),
        (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


ORACLE = r"""
with recursive d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix-' || coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select source, source_size, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r(n, level, clamped) as (
  select 0, (select sum(source_size) * 1.5::double / sum(weight) from w), cast(0 as bigint)
  union all
  select n + 1,
    ((select sum(source_size) * 1.5::double from w) - coalesce((select sum(source_size * 2.0::double) from w where source_size * 2.0::double < r.level * weight), 0))
      / (select sum(weight) from w where not source_size * 2.0::double < r.level * weight),
    (select count(*) from w where source_size * 2.0::double < r.level * weight)
  from r where n < 100),
t as (select source, source_size, least(source_size * 2.0::double, (select max(level) from r) * weight) as target from w),
u as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as repeats from t),
p as (
  select d.doc_id, d.size, u.source_size, u.target, u.repeats, cast(floor(u.target + 0.5) as bigint) - u.repeats * u.source_size as rest,
         sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
  from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target, cast(repeats * size + greatest(0, least(size, rest - before)) as bigint) as taken from p
"""

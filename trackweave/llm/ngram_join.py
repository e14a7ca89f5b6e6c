"""N-gram Jaccard join: documents linked by their word shingles, as a blocked product of a sparse matrix.

The matrix has a row per document and a column per k-word shingle. The product with its own transpose
holds the overlap of every two documents. It is never made whole:

1. Shingles are put in one order, rarest first by a count sketch of fixed size (whose errors cost time,
   never links). Two sets of similarity t share a shingle among the first `n - ceil(t n) + 1` of both, so
   only these columns of a row enter the product.
2. A column that one document has adds to no overlap and is dropped. Of the others each document is
   multiplied with the lead of its column and size band first. It goes on with the lead that it overlaps most, and the
   pair is confirmed on the full sets. There is one pair a document, however many copies there are; the links
   found give components.
3. The rest of the product is over columns whose documents lie in different components, and there over
   pairs of a document outside the column's main component with any other of the column, in another component
   and of a size that can match. Columns of at most `NARROW` documents are multiplied together, and the
   overlaps added up over all of them. A wider column is cut into tiles of at most `TILE` rows a side, however hot it
   is; its rows bring the first columns that they share with anyone, so a block knows the whole overlap there of each of
   its pairs. A pair is discarded when its overlap among the first columns, and all that the larger rest could
   add, are below what the sizes need. So documents that have a common passage and little else leave
   their block without a trace. What is left is confirmed on the full sets.

Documents with equal sets are one row of the matrix, so copies are never multiplied with each other.

Defined results: null texts and texts without words have an empty set, link with nothing and stay
alone; of repeated rows each is given; rows with a null id take part in nothing and have a null
component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .near_dedup import SKETCH, SKETCH_BITS, _confirm, _sets, _shingle_blocks

#: Documents of a column that is not cut; rows of a wider one that one side of a block holds; pairs that are looked at together.
NARROW = 64
TILE = 512
PAIRS = 1 << 20
#: Ratio of a size band, in per cent: members of a band differ by at most as much.
BAND = 15


def _sketch(k: int):
    """(place, n): a task's shingles counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for _, _, shingles, _ in _shingle_blocks(batch.column(0), k):
                total += np.bincount((shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    return run


def first_columns(size: int, per_cent: int) -> int:
    """How many of a set's shingles come first: two linked sets share one of them."""
    return size - -(-per_cent * size // 100) + 1


def _profile(k: int, per_cent: int, counts):
    """(id, n_shingles, set_key, first shingles in order) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for batch in batches:
            for first, last, shingles, at in _shingle_blocks(batch.column(1), k):
                sizes, keys, firsts = [], [], []
                for i in range(last - first):
                    own = np.unique(shingles[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    keys.append(np.array([own.sum(dtype=np.uint64), np.bitwise_xor.reduce(own), len(own)], dtype=np.uint64).tobytes() if len(own) else None)
                    rare = np.lexsort((own, held[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    firsts.append(own[rare[: first_columns(len(own), per_cent)]] if len(own) else own)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], names=["id", "n_shingles", "set_key", "columns"])

    return run


def _narrow_product(per_cent: int):
    """(u, v, nu, nv, shared, most): overlaps of each column's loose rows with its other rows; rows are sorted by column."""

    def multiply(own: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        fresh = np.ones(len(own["token"]), bool)
        fresh[1:] = own["token"][1:] != own["token"][:-1]
        block = np.cumsum(fresh)
        left, right = np.flatnonzero(own["left"]), np.flatnonzero(~own["left"])
        ids, doc = np.unique(own["doc"], return_inverse=True)
        begin, end = np.searchsorted(block[right], block[left]), np.searchsorted(block[right], block[left], "right")
        made, done, found = np.cumsum(end - begin), 0, [np.zeros((5, 0), np.int64)]
        while done < len(left):  # as many left rows at a time as make PAIRS pairs
            upto = max(done + 1, int(np.searchsorted(made, (made[done - 1] if done else 0) + PAIRS, "right")))
            sizes = (end - begin)[done:upto]
            x = np.repeat(left[done:upto], sizes)
            y = right[np.repeat(begin[done:upto] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            nx, ny = own["size"][x], own["size"][y]
            most = np.minimum(nx - own["place"][x], ny - own["place"][y])
            keep = (own["root"][x] != own["root"][y]) & (~own["loose"][y] | (doc[x] < doc[y])) & (100 * np.minimum(nx, ny) >= per_cent * np.maximum(nx, ny))
            # a pair has one direction in all columns, whichever side is loose there
            x, y, nx, ny, most = (z[keep] for z in (x, y, nx, ny, most))
            back = doc[x] < doc[y]
            found.append(np.stack([np.where(back, doc[y], doc[x]), np.where(back, doc[x], doc[y]), np.where(back, ny, nx), np.where(back, nx, ny), most]))
            done = upto
        pairs = np.concatenate(found, axis=1)
        if not pairs.shape[1]:
            return None
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        fresh = np.flatnonzero(np.concatenate([[True], (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])]))
        ends = [pa.array(ids[pairs[i, fresh]]) for i in (0, 1)]
        rest = [pa.array(x.astype(np.int32)) for x in (pairs[2, fresh], pairs[3, fresh], np.diff(np.append(fresh, pairs.shape[1])), np.maximum.reduceat(pairs[4], fresh))]
        return pa.RecordBatch.from_arrays(ends + rest, names=["u", "v", "nu", "nv", "shared", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("token", "left", "doc", "root", "loose", "size", "place"), None
        for batch in batches:
            own = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                own = {n: np.concatenate([held[n], own[n]]) for n in names}
            # the last column may go on in the next batch
            last = own["token"] == own["token"][-1] if len(own["token"]) else np.zeros(0, bool)
            held = {n: x[last] for n, x in own.items()}
            done = multiply({n: x[~last] for n, x in own.items()}) if not last.all() else None
            if done is not None:
                yield done
        if held is not None and len(held["token"]):
            done = multiply(held)
            if done is not None:
                yield done

    return run


def _tile(per_cent: int, block: pa.Table) -> pa.RecordBatch:
    """The pairs of a block that its rows' first columns do not rule out."""
    left = block.column("left").to_numpy()
    size, loose = block.column("size").to_numpy().astype(np.int64), block.column("loose").to_numpy()
    ids, doc = np.unique(block.column("doc").to_numpy(zero_copy_only=False), return_inverse=True)
    root = np.unique(block.column("root").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    lists = block.column("columns").combine_chunks()
    held, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    both = np.intersect1d(held[left[row]], held[~left[row]])
    keep = np.isin(held, both)
    at = np.searchsorted(both, held[keep])
    matrix = np.zeros((len(lists), len(both)), dtype=np.float32)
    matrix[row[keep], at] = 1
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    shared = matrix[x] @ matrix[y].T
    outside = -(-per_cent * size // 100) - 1
    nx, ny = size[x][:, None], size[y][None, :]
    bound = shared + np.maximum(outside[x][:, None], outside[y][None, :])
    good = (shared > 0) & ((100 + per_cent) * bound >= per_cent * (nx + ny)) & (100 * np.minimum(nx, ny) >= per_cent * np.maximum(nx, ny))
    good &= (root[x][:, None] != root[y][None, :]) & (~loose[y][None, :] | (doc[x][:, None] < doc[y][None, :]))
    i, j = np.nonzero(good)
    u, v = doc[x[i]], doc[y[j]]
    return pa.RecordBatch.from_arrays([pa.array(ids[np.maximum(u, v)]), pa.array(ids[np.minimum(u, v)])], names=["u", "v"])


def _tiles_product(per_cent: int):
    """(u, v) of blocks of wide columns; rows are sorted by block, and a block is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            own = [held.column(c).to_numpy() for c in ("token", "a", "b")]
            ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0)) + 1
            for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                yield _tile(per_cent, held.slice(begin, end - begin))
            held = held.slice(int(ends[-1])) if len(ends) else held
        if held is not None and held.num_rows:
            yield _tile(per_cent, held)

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, per_cent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    counts = np.zeros(SKETCH, dtype=np.int64)
    sums = rows.select("text").mapInArrow(_sketch(k), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "sketch").toArrow()
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    profile = materialize(rows.mapInArrow(_profile(k, per_cent, shared), f"id {kind}, n_shingles long, set_key binary, columns array<long>"), "profile")
    # a row of the matrix for each class; equal sets have equal first columns
    classes = profile.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").cast("int").alias("size"), F.first("columns").alias("columns"))
    classes = materialize(classes, "classes")
    matrix = classes.select("id", "size", F.posexplode("columns").alias("place", "token"))
    columns = matrix.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("token")
    entries = materialize(matrix.join(columns, "token"), "entries")

    def links(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (u, v) that hold on the full sets."""
        ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        # a merge join at every size: the ids grow with the corpus, so a plan that broadcasts them would not last
        sets = materialize(rows.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(k), f"id {kind}, shingles binary"), "sets")
        both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")
        return materialize(both.mapInArrow(_confirm(per_cent), f"u {kind}, v {kind}"), "confirmed")

    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / (100 - BAND)))).cast("int")
    banded = entries.withColumn("band", band)
    leads = banded.groupBy("token", "band").agg(F.min("id").alias("v"), F.max("id").alias("last")).filter("v <> last")
    led = banded.join(leads.select("token", "band", "v"), ["token", "band"]).filter("id <> v").groupBy("id", "v").count()
    best = led.groupBy("id").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    found = links(materialize(best.select(F.col("id").alias("u"), "v"), "led"))
    roots = materialize(connected_components(found), "roots")
    crossed = _across(entries, roots, kind, per_cent)
    more = links(crossed)
    if more.first() is not None:
        roots = materialize(connected_components(found.unionByName(more)), "roots")

    moved = classes.join(roots, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("root", "id").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return profile.select("id", "n_shingles", "set_key").join(moved, "set_key", "left").select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


def _across(entries: DataFrame, roots: DataFrame, kind: str, per_cent: int) -> DataFrame:
    """Pairs in different components that the blocked product does not discard."""
    labelled = materialize(entries.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("root", "id").alias("root"), "size", "place"), "labelled")
    counts = labelled.groupBy("token", "root").count()
    mixed = counts.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n"), F.max("count").alias("most")).filter("parts > 1")
    open_ = labelled.join(mixed.select("token", "main", "n", "most"), "token").withColumn("loose", F.col("root") != F.col("main")).withColumnRenamed("id", "doc")
    open_ = materialize(open_.select("token", "doc", "root", "size", "place", "loose", "n", "most"), "open")

    narrow = open_.filter(F.col("n") <= NARROW)
    sides = narrow.select("*", F.explode(F.when(F.col("loose"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("left"))
    dealt = sides.repartition("token").sortWithinPartitions("token").select("token", "left", "doc", "root", "loose", "size", "place")
    total = dealt.mapInArrow(_narrow_product(per_cent), f"u {kind}, v {kind}, nu int, nv int, shared int, most int").groupBy("u", "v")
    total = total.agg(F.first("nu").alias("nu"), F.first("nv").alias("nv"), F.sum("shared").alias("shared"), F.max("most").alias("most"))
    outside = lambda n: F.ceil(F.lit(per_cent) * n / 100) - 1  # noqa: E731  shingles that do not come first
    bound = F.least(F.col("most"), F.col("shared") + F.greatest(outside(F.col("nu")), outside(F.col("nv"))))
    kept = total.filter(F.lit(100 + per_cent) * bound >= F.lit(per_cent) * (F.col("nu") + F.col("nv"))).select("u", "v")

    wide = open_.filter(F.col("n") > NARROW)
    lists = labelled.join(wide.select(F.col("doc").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.collect_list("token").alias("columns"))
    wide = wide.join(lists.withColumnRenamed("id", "doc"), "doc").withColumns({"cols": F.ceil(F.col("n") / TILE).cast("int"), "rows": F.ceil((F.col("n") - F.col("most")) / TILE).cast("int"), "tile": F.xxhash64("doc")})
    # a loose row stands on the left of its tile in all blocks of its row of blocks; every row stands on the right of one in each
    left = wide.filter("loose").select("*", F.pmod("tile", "rows").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("b"), F.lit(True).alias("left"))
    right = wide.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("a"), F.pmod("tile", "cols").cast("int").alias("b"), F.lit(False).alias("left"))
    tiles = left.unionByName(right).select("token", "a", "b", "left", "doc", "root", "loose", "size", "columns").repartition("token", "a", "b").sortWithinPartitions("token", "a", "b")
    crossed = kept.unionByName(tiles.mapInArrow(_tiles_product(per_cent), f"u {kind}, v {kind}")).distinct()
    return materialize(crossed, "crossed", 4_000)


#: Exact: linked sets share one of the shingles that come first, rarest before others, in both.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as materialized (select distinct doc_id, unnest(case when len(w) between 1 and 3 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)] end) as shingle from d),
num as materialized (select shingle, row_number() over (order by df, shingle) as s from (select shingle, count(*) as df from sh group by shingle) f),
sets as materialized (select doc_id, list(s order by s) as own, count(*) as n from sh join num using (shingle) group by doc_id),
cls as materialized (select own, any_value(n) as n, min(doc_id) as rep from sets group by own),
pre as materialized (select rep, n, unnest(own[1 : n - (85 * n + 99) // 100 + 1]) as s from cls),
cand as materialized (select distinct a.rep as x, b.rep as y from pre a join pre b on a.s = b.s and a.rep < b.rep and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n),
link as materialized (select x, y from (select x, y, a.n + b.n as total, len(list_intersect(a.own, b.own)) as common from cand join cls a on a.rep = x join cls b on b.rep = y) p where 100 * common >= 85 * (total - common)),
reach(node, root) as (select rep, rep from cls union select y, root from reach join (select x, y from link union all select y, x from link) e on e.x = node),
comp as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(root, d.doc_id) as component_id
from d left join (select sets.doc_id, sets.n, comp.root from sets join cls using (own) join comp on comp.node = cls.rep) c using (doc_id)
"""

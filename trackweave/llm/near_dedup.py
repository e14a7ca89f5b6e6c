"""Near-duplicate documents: multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its distinct k-word shingles. Its signature has `CHUNKS * CHUNK` positions
of `BITS` bits. By pigeonhole, two signatures that differ in at most `CHUNKS * (ERRORS + 1) - 1`
positions have a chunk with at most `ERRORS` differing positions; every chunk is therefore entered
in the index under each of its parts with `ERRORS` positions left out, and such pairs always meet.
With 12 chunks of 5 positions and one error that is a distance of 23 of 60. Beyond it pairs still
meet often: a pair with similarity 0.8 exactly is missed with probability 1.1e-7 (each chunk is
shared with probability 0.737).

Links are confirmed on the full sets. Only what is needed for components is confirmed, and nothing
that could change them is left out:

1. Documents with equal sets form a class; one representative each goes on.
2. In every bucket of the index each member is tried against the bucket's smallest member. The
   links found give components.
3. Buckets whose members lie in several components may hold more links. Members outside a bucket's
   largest component are matched with all members of such buckets by an exact filter instead of in
   pairs: shingles are put in one order, rarest first, and a linked pair must share one of its first
   shingles, with enough shingles left behind it. How many are first depends on both sizes, so sizes
   are dealt into bands and each document is entered once for every band that a partner may be in.
   The order comes from a count sketch of fixed size; its errors cost time, never links.

Defined results: null texts and texts without words have an empty set, link with nothing and stay
alone; of repeated rows each is given; rows with a null id take part in nothing, have a null
component and are not kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .text_arrays import LOWER, NOT_SPACE, blocks, mix, shingle_hashes, utf8, word_bounds, word_hashes

CHUNKS, CHUNK, ERRORS, BITS = 12, 5, 1, 16
POSITIONS = CHUNKS * CHUNK

#: Counters of the sketch that orders shingles, and the ratio of a size band.
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
BAND = 1.05

_FACTORS = (np.random.default_rng(20_011).integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _shingle_blocks(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(texts)
    for first, last in blocks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, words = word_bounds(part, at, NOT_SPACE)
        yield first, last, *shingle_hashes(word_hashes(part, starts, ends), words, k)


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of POSITIONS 16-bit minima per document; rows without shingles are 0."""
    out = np.zeros((len(at) - 1, POSITIONS), dtype=np.uint16)
    have = np.flatnonzero(np.diff(at))
    if len(have):
        values, begin = (shingles >> np.uint64(32)).astype(np.uint32), at[:-1][have]
        for j, factor in enumerate(_FACTORS):
            out[have, j] = np.minimum.reduceat(values * factor, begin).astype(np.uint16)
    return out


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signed = [], [], []
            for first, last, shingles, at in _shingle_blocks(batch.column(1), k):
                signed += [x.tobytes() for x in signatures(shingles, at)]
                for i in range(last - first):
                    own = np.unique(shingles[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    keys.append(np.array([own.sum(dtype=np.uint64), np.bitwise_xor.reduce(own), len(own)], dtype=np.uint64).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], names=["id", "n_shingles", "set_key", "signature"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, at in _shingle_blocks(batch.column(1), k):
                own = [np.unique(shingles[at[i] : at[i + 1]]).tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(own, pa.binary())], names=["id", "shingles"])

    return run


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for every chunk and every position left out; the key is hashed with its place, a clash only adds a pair to try."""
    for batch in batches:
        signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
        for chunk in range(CHUNKS):
            for out in range(CHUNK):
                key = np.zeros(len(signed), dtype=np.uint64)
                for j in range(CHUNK):
                    if j != out:
                        key = (key << np.uint64(BITS)) | signed[:, chunk * CHUNK + j]
                place = np.uint64((chunk * CHUNK + out + 1) * 0x632BE59BD9B4E019 % (1 << 64))
                yield pa.RecordBatch.from_arrays([pa.array(mix(key ^ place).view(np.int64)), batch.column(0)], names=["key", "id"])


def _sketch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros(SKETCH, dtype=np.int64)
        for own in batch.column(0):
            total += np.bincount(np.frombuffer(own.as_buffer(), dtype=np.uint64) >> np.uint64(64 - SKETCH_BITS), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])


def _band(size: int) -> int:
    return int(math.log(size) / math.log(BAND))


def _band_least(band: int) -> int:
    """A size that none in the band is below; one less than the bound, so rounding never matters."""
    return max(1, math.floor(BAND**band) - 1)


def _first_shingles(counts: np.ndarray, per_cent: int):
    """Rows (token, own band, partner band, id, root, loose, size, place) for the first shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                size, count = len(own), counts[own >> np.uint64(64 - SKETCH_BITS)]
                own, count = (x[np.lexsort((own, count))] for x in (own, count))
                tokens, bands, places = [], [], []
                for band in range(_band(max(1, per_cent * size // 100 - 1)), _band(100 * size // per_cent + 1) + 1):
                    # linked sets share at least per_cent / (100 + per_cent) of both sizes together
                    least = math.ceil(per_cent * (size + max(_band_least(band), math.ceil(per_cent * size / 100))) / (100 + per_cent))
                    place = np.flatnonzero(count[: max(0, size - least + 1)] > 1)
                    tokens.append(own[place])
                    places.append(place)
                    bands.append(np.full(len(place), band))
                token = np.concatenate(tokens).view(np.int64)
                n = len(token)
                fixed = [pa.repeat(batch.column(j)[i], n) for j in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.full(n, _band(size), np.int32)), pa.array(np.concatenate(bands).astype(np.int32)), *fixed, pa.array(np.full(n, size, np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["token", "own", "partner", "id", "root", "loose", "size", "place"],
                )

    return run


def _confirm(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= per_cent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    profile = materialize(rows.mapInArrow(_profile(k), f"id {kind}, n_shingles long, set_key binary, signature binary"), "profile")
    classes = profile.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")

    keys = materialize(classes.select("id", "signature").mapInArrow(_index_keys, f"key long, id {kind}"), "keys")
    buckets = materialize(keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = materialize(keys.join(buckets.filter("size > 2").select("key", "lead"), "key"), "members")
    pairs = buckets.filter("size = 2").select(F.col("last").alias("u"), F.col("lead").alias("v"))
    pairs = materialize(pairs.unionByName(members.filter("id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v"))).distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    # a merge join at every size: the ids grow with the corpus, so a plan that broadcasts them would not last
    sets = materialize(rows.join(needed.hint("merge"), "id", "left_semi").mapInArrow(_sets(k), f"id {kind}, shingles binary"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """The distinct pairs(u, v) that hold on the full sets."""
        pairs = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")
        return materialize(pairs.mapInArrow(_confirm(per_cent), f"u {kind}, v {kind}"), "confirmed")

    found = links(pairs)
    roots = materialize(connected_components(found), "roots")
    more = links(_across(_open_documents(members, roots), sets, kind, per_cent))
    if more.first() is not None:
        roots = materialize(connected_components(found.unionByName(more)), "roots")

    moved = classes.join(roots, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("root", "id").alias("root"), ((F.col("rows") > 1) | F.col("root").isNotNull()).alias("moved")).filter("moved")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return profile.join(moved.drop("moved"), "set_key", "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def _open_documents(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root, loose) of documents in buckets that span several components; loose ones are outside some bucket's largest."""
    labelled = members.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    counts = labelled.groupBy("key", "root").count()
    spread = counts.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = labelled.join(spread.select("key", "main"), "key")
    return materialize(open_.groupBy("id", "root").agg(F.max(F.col("root") != F.col("main")).alias("loose")), "open")


def _across(documents: DataFrame, sets: DataFrame, kind: str, per_cent: int) -> DataFrame:
    """Pairs in different components, at least one of them loose, that the first shingles do not rule out."""
    own = materialize(documents.join(sets, "id").select("id", "root", "loose", "shingles"), "open-sets")
    counts = np.zeros(SKETCH, dtype=np.int64)
    sums = own.select("shingles").mapInArrow(_sketch_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    first = own.mapInArrow(_first_shingles(np.minimum(counts, (1 << 31) - 1).astype(np.int32), per_cent), f"token long, own int, partner int, id {kind}, root {kind}, loose boolean, size int, place int")
    first = materialize(first, "first")
    a = first.filter("loose").select("token", F.col("own").alias("x"), F.col("partner").alias("y"), F.col("id").alias("u"), F.col("root").alias("ur"), F.col("size").alias("us"), F.col("place").alias("up"))
    b = first.select("token", F.col("partner").alias("x"), F.col("own").alias("y"), F.col("id").alias("v"), F.col("root").alias("vr"), F.col("size").alias("vs"), F.col("place").alias("vp"), F.col("loose").alias("vl"))
    left = F.least(F.col("us") - F.col("up"), F.col("vs") - F.col("vp"))
    fits = F.lit(100) * left >= F.lit(per_cent) * (F.col("us") + F.col("vs") - left)
    crossed = a.join(b, (a.token == b.token) & (a.x == b.x) & (a.y == b.y) & (F.col("ur") != F.col("vr")) & (~F.col("vl") | (F.col("u") < F.col("v"))) & fits)
    return materialize(crossed.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "crossed")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents without those that are linked, directly or over others, with one of smaller id. Rows with a null id stay."""
    gone = near_dedup(docs, id_col, text_col, k, per_cent).filter(F.col(id_col).isNotNull() & ~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


#: Exact: linked sets share one of the shingles that come first, rarest before others, in both; n - ceil(0.8 n) + 1 of n are first.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as materialized (select distinct doc_id, unnest(case when len(w) = 1 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as shingle from d),
num as materialized (select shingle, row_number() over (order by df, shingle) as s from (select shingle, count(*) as df from sh group by shingle) f),
sets as materialized (select doc_id, list(s order by s) as own, count(*) as n from sh join num using (shingle) group by doc_id),
cls as materialized (select own, any_value(n) as n, min(doc_id) as rep from sets group by own),
pre as materialized (select rep, n, unnest(own[1 : n - (80 * n + 99) // 100 + 1]) as s from cls),
cand as materialized (select distinct a.rep as x, b.rep as y from pre a join pre b on a.s = b.s and a.rep < b.rep and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
link as materialized (select x, y from (select x, y, a.n + b.n as total, len(list_intersect(a.own, b.own)) as common from cand join cls a on a.rep = x join cls b on b.rep = y) p where 100 * common >= 80 * (total - common)),
reach(node, root) as (select rep, rep from cls union select y, root from reach join (select x, y from link union all select y, x from link) e on e.x = node),
comp as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(root, d.doc_id) as component_id, d.doc_id = coalesce(root, d.doc_id) as kept
from d left join (select sets.doc_id, sets.n, comp.root from sets join cls using (own) join comp on comp.node = cls.rep) c using (doc_id)
"""

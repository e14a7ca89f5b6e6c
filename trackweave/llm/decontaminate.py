"""Benchmark decontamination with an FM-index per shard of the training texts.

Each Arrow batch of documents is cut into shards. Words that the benchmark surely does not hold (by a
bit table of fixed size over word hashes) cannot be part of any test phrase and become separators, and
stretches between separators that are shorter than the shortest phrase are left out. Over the rest the
shard builds, once, a suffix array, the Burrows-Wheeler transform in a wavelet matrix, and sampled
suffix positions. Test phrases are searched backwards at once through wavelet ranks; their
occurrences are located by walking to the next sampled position, and covered words are merged.

A test phrase is a window of `window` consecutive words of a benchmark item; an item of fewer words,
but not none, is one phrase. The benchmark is a query set in blocks of about `block_words` words:
executors make the blocks and write them to the shared folder, a file each, and Spark hands the files
to the executors' disks. The documents go through one map step, in which a shard is searched for one
block after the other, so a task holds one block at a time and the driver none.

Defined results: null texts have no words and null or wordless items no phrases; with an empty
benchmark nothing is hit; benchmark rows with one id are one item, and null ids count as one item
that sorts as an empty string; repeated documents are each given; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .text_arrays import ALNUM, LOWER, blocks, utf8, word_bounds, word_hashes

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 1 << 21
SAMPLE = 8
#: Bits of a word's hash that address the table of words which the benchmark may hold (2 MB at any size).
FILTER_BITS = 24


class Phrases:
    """A block's test phrases, each once, by where it begins in the words of the block, with the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, ALNUM)
        self.vocabulary, words = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        #: The block's words by their place in the vocabulary.
        self.words = words.reshape(-1).astype(np.int32)
        self.ids = sorted({item for item, _ in items})
        place = {item: i for i, item in enumerate(self.ids)}
        item = np.array([place[item] for item, _ in items], np.int32)
        counts = np.diff(first)
        sizes = np.minimum(counts, window)
        #: length -> (first word of each phrase, first entry of each in the next, items in order of phrases)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            many = counts[own] - size + 1
            begin = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            _, one, which = np.unique(self.words[begin[:, None] + np.arange(size)], axis=0, return_index=True, return_inverse=True)
            held = np.unique(np.stack([which.reshape(-1), np.repeat(item[own], many)], axis=1), axis=0)
            self.by_length[size] = begin[one], np.searchsorted(held[:, 0], np.arange(len(one) + 1)), held[:, 1].astype(np.int32)
        self.shortest = min(self.by_length, default=0)

    def bits(self) -> np.ndarray:
        """The table of FILTER_BITS in which the block's words are set."""
        table = np.zeros(1 << FILTER_BITS, bool)
        table[_slot(self.vocabulary)] = True
        return np.packbits(table)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per level."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            upto = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, upto, len(symbols) - int(upto[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often symbol[i] stands before each of the ends[..][i]."""
        begin, ends = np.zeros(len(symbol), np.int64), [np.asarray(end, np.int64) for end in ends]
        for bit, upto, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)

            def down(x: np.ndarray) -> np.ndarray:
                return np.where(one, zeros + upto[x], x - upto[x])

            begin, ends = down(begin), [down(end) for end in ends]
        return [end - begin for end in ends]

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the given places, and how often each stands before its place."""
        symbol, begin, rows = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.asarray(rows, np.int64)
        for bit, upto, zeros in self.levels:
            one = (upto[rows + 1] - upto[rows]).astype(bool)
            symbol |= one.astype(np.int64) << bit
            begin, rows = (np.where(one, zeros + upto[x], x - upto[x]) for x in (begin, rows))
        return symbol, rows - begin


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of non-negative ranks, by prefix doubling."""
    n, step = len(ranks), 1
    _, ranks = np.unique(ranks, return_inverse=True)
    ranks = ranks.astype(np.int64)
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = ranks[step:] + 1
        keys = ranks * (n + 1) + later
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        fresh = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        ranks = np.empty(n, np.int64)
        ranks[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Count and locate phrases in a sequence of codes in which 0 separates stretches.

    The sequence begins and ends with 0. Separators are told apart by their place in the suffix
    order, so the order is total after as many doublings as the longest stretch needs; phrases
    never hold a 0 and walks stop before one, as the first position of a stretch is sampled.
    """

    def __init__(self, codes: np.ndarray, most: int, sample: int = SAMPLE):
        stops = codes == 0
        n_stops = int(stops.sum())
        order = suffix_array(np.where(stops, np.cumsum(stops) - 1, codes + n_stops))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=most + 1))])
        self.transform = WaveletMatrix(codes[order - 1], most)
        since = np.arange(len(codes)) - np.maximum.accumulate(np.where(stops, np.arange(len(codes)), 0)) - 1
        sampled = (since % sample == 0) & ~stops
        self.position = np.where(sampled[order], order, -1)

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length, the rows of suffixes that begin with each: from, to."""
        return self.search(*phrases.shape, lambda which, j: phrases[which, j])

    def search(self, n: int, length: int, symbols: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same for n phrases of which `symbols` gives the j-th words: only phrases still found are asked for more."""
        low, high, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        symbol = symbols(live, length - 1)
        low[:], high[:] = self.below[symbol], np.where(symbol > 0, self.below[symbol + 1], self.below[symbol])
        for j in range(length - 2, -1, -1):
            live = live[low[live] < high[live]]
            symbol = symbols(live, j)
            high[live[symbol == 0]] = low[live[symbol == 0]]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if not len(live):
                break
            before, upto = self.transform.rank(symbol, low[live], high[live])
            low[live], high[live] = self.below[symbol] + before, self.below[symbol] + upto
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in the given rows."""
        out, walked, open_, rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(open_):
            known = self.position[rows]
            done = known >= 0
            out[open_[done]] = known[done] + walked
            open_, rows = open_[~done], rows[~done]
            symbol, before = self.transform.at(rows)
            rows = self.below[symbol] + before
            walked += 1
        return out


class Shard:
    """The words of some documents, indexed once, for any number of blocks of phrases.

    `hashes` are the words of all documents and `first` the index of each document's first word;
    `bits` tells which words the benchmark may hold, and `shortest` is its shortest phrase.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, bits: np.ndarray, shortest: int):
        self.index = None
        slot = _slot(hashes)
        likely = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
        known = np.zeros(len(hashes) + len(first) + 1, bool)  # a gap before every document and at the end
        spread = np.arange(len(hashes)) + np.searchsorted(first[:-1], np.arange(len(hashes)), "right")
        known[spread] = likely
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        begin, size = edges[::2], edges[1::2] - edges[::2]
        begin, size = begin[size >= shortest], size[size >= shortest]
        if not shortest or not len(begin):
            return
        origin = np.full(len(known), -1)
        origin[spread] = np.arange(len(hashes))
        at = np.concatenate([[1], 1 + np.cumsum(size + 1)])
        shift = np.concatenate([[0], np.cumsum(size)[:-1]])
        inner = np.repeat(at[:-1] - shift, size) + np.arange(size.sum())
        self.source = np.full(at[-1], -1)
        self.source[inner] = origin[np.repeat(begin - shift, size) + np.arange(size.sum())]
        self.vocabulary, codes = np.unique(hashes[self.source[inner]], return_inverse=True)
        text = np.zeros(at[-1], np.int64)
        text[inner] = codes.reshape(-1) + 1
        self.index = FMIndex(text, len(self.vocabulary))

    def find(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Word positions at which phrases begin, by length: (positions, length, phrase numbers of that length)."""
        if self.index is None:
            return
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == phrases.vocabulary, at + 1, 0)
        for length, (begin, _, _) in phrases.by_length.items():
            low, high = self.index.search(len(begin), length, lambda which, j, begin=begin: code[phrases.words[begin[which] + j]])
            hits = np.flatnonzero(low < high)
            many = (high - low)[hits]
            if len(hits):
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield self.source[self.index.locate(np.repeat(low[hits], many) + within)], length, np.repeat(hits, many)


@functools.lru_cache(maxsize=1)
def _block(name: str) -> Phrases:
    """A block of phrases from the files that Spark brought to this executor; the last one read stays in memory."""
    return pickle.loads(pq.read_table(SparkFiles.get(name), columns=["block"], partitioning=None).column("block")[0].as_py())


def _scan(names: list[str], bits: np.ndarray, shortest: int):
    """Words hit and items found of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for begin, end in blocks(offsets, SHARD_BYTES):
                at = offsets[begin : end + 1] - offsets[begin]
                part = LOWER[data[offsets[begin] : offsets[end]]]
                starts, ends, first = word_bounds(part, at, ALNUM)
                shard = Shard(word_hashes(part, starts, ends), first, bits, shortest)
                cover = np.zeros(len(starts) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(end - begin)]
                for name in names if shard.index else []:
                    phrases = _block(name)
                    for positions, length, which in shard.find(phrases):
                        np.add.at(cover, positions, 1)
                        np.add.at(cover, positions + length, -1)
                        _, upto, held = phrases.by_length[length]
                        docs = np.searchsorted(first, positions, "right") - 1
                        for doc, phrase in np.unique(np.stack([docs, which], axis=1), axis=0).tolist():
                            items[doc].update(phrases.ids[i] for i in held[upto[phrase] : upto[phrase + 1]])
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                edges = np.flatnonzero(np.diff(hit.astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in range(end - begin)]
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    doc = int(np.searchsorted(first, a, "right")) - 1
                    while a < b:  # a stretch of hit words may go on in the next document
                        upto = min(int(first[doc + 1]), int(b))
                        if a < upto:
                            spans[doc].append({"word": int(a - first[doc]), "words": int(upto - a), "start": int(starts[a] - at[doc]), "end": int(ends[upto - 1] - at[doc])})
                        a, doc = max(int(a), upto), doc + 1
                found = [pa.array(np.diff(first), pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], *found], names=["id", "n_words", "spans", "items"])

    return run


_SPANS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<word:long,words:long,start:long,end:long>>"


def _write_blocks(window: int, block_words: int):
    """Blocks of phrases from (item, text) rows, with their tables of words and shortest phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items.append((item, text))
                words += 1 + len(text) // 6
                if words >= block_words:
                    yield block(items)
                    items, words = [], 0
        if items:
            yield block(items)

    def block(items: list[tuple[str, str]]) -> pa.RecordBatch:
        phrases = Phrases(items, window)
        values = [pa.array([pickle.dumps(phrases, 5)], pa.binary()), pa.array([phrases.bits().tobytes()], pa.binary()), pa.array([phrases.shortest], pa.int32())]
        return pa.RecordBatch.from_arrays(values, names=["block", "bits", "shortest"])

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> tuple[list[str], np.ndarray, int]:
    """Write the benchmark's phrases in blocks and send the files to executors: their names, the table of words, the shortest phrase.

    The driver sees the tables one after the other (2 MB each) and adds them up.
    """
    spark, path = benchmark.sparkSession, new_path(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(1 + F.floor(F.length("text") / 6)), F.lit(0)).alias("words")).first()
    parts = rows.repartition(max(1, min(size.rows, size.words // block_words)), "item", "text").mapInArrow(_write_blocks(window, block_words), "block binary, bits binary, shortest int")
    # a file holds one block, so that it is read by itself
    parts.write.option("maxRecordsPerFile", 1).parquet(path)
    bits, shortest, names = np.zeros(1 << (FILTER_BITS - 3), np.uint8), [], []
    for row in spark.read.schema("bits binary, shortest int").parquet(path).filter("shortest > 0").select("bits", "shortest", "_metadata.file_path").toLocalIterator():
        bits |= np.frombuffer(row.bits, np.uint8)
        shortest.append(row.shortest)
        names.append(row.file_path.rsplit("/", 1)[1])
        spark.sparkContext.addFile(row.file_path)
    return names, bits, min(shortest, default=0)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids as sorted strings), spans, contaminated.

    `spans` are the merged stretches to remove: first word and number of words, and first and last
    byte of the UTF-8 text. The documents go through one map step whatever the number of blocks;
    nothing is shuffled or put together again, and rows stay apart whatever their ids are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scan = _scan(*benchmark_blocks(benchmark, item_col, item_text_col, window, block_words))
    hits = rows.mapInArrow(scan, f"id {kind}, n_words long, spans {_SPANS_SQL}, items array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return hits.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans", (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no test phrase, with all their columns. Rows with a null id stay."""
    hit = find_contamination(docs, benchmark, id_col, text_col, **options).filter("contaminated").filter(F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti").select(*docs.columns)


ORACLE = r"""
with b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ph as (select distinct item, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as phrase
       from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
win as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as phrase
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from ph) where len(w) >= size)),
hits as (select doc_id, i, size, item from win join ph using (size, phrase)),
words as (select doc_id, count(distinct pos) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as pos from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

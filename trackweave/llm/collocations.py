"""Phrase collocations: frequent phrases of 2 to 5 words, counted in depth-truncated suffix subtrees.

A text is lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]`, and those into words. Every
place in a piece begins a suffix of at most `DEPTH` words, and a phrase occurs as often as suffixes
begin with it. The subtrees of suffixes are built apart, after vertical partitioning:

1. One pass counts words per language, and suffixes of two words and more in `BUCKETS` buckets by the hash of their first two
   words. The `COMMON` most frequent words get codes of two bytes; others are spelled out.
2. Buckets are packed into groups up to a budget: a `groups`-th of all words, `MOST` at most. A bucket over the budget is
   drawn out to all words of its suffixes: those are added up within each block of texts, so however many are equal
   they are a few rows, and are dealt by hash into further groups, twice as many as their number fills.
3. Another pass hands on the suffixes, one row for each block and group: a table of codes, as bytes.
4. A task gets a group at a time and splits its suffixes word by word: the equal beginnings are the nodes of its subtrees,
   and counts are sums over their leaves. Only nodes that reach the least count are split further. In groups that were drawn out a shorter
   node may go on elsewhere: there all are kept, and added up at the end.

A group holds about a budget of suffixes at most, so a task's memory is bounded whatever the size of the corpus and its most frequent
phrases; only words far longer than usual, which are spelled out, make a group larger.

Scores are exact: decimals of 38 digits. Of a candidate only phrases that are one word longer are
tried for containing it, as an occurrence of a longer one is also one of those.

Defined results: null and empty texts count as empty; a null language is `und`; repeated rows count
each time; ids and other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize
from .text_arrays import LOWER, blocks, mix, utf8

#: Words of the longest phrase.
DEPTH = 5
#: Groups that suffixes are dealt into at least, the suffixes of one at most, and the buckets that are packed into them.
GROUPS = 1024
MOST = 1 << 21
BUCKETS = 1 << 16
#: Words with codes of two bytes (0 ends a suffix), and the code of a word that is spelled out.
COMMON = 254 * 256
SPELLED = 0xFFFF
#: Bytes of counted words that a task adds up before it hands them on.
HELD = 1 << 24
#: Bytes of text that are added up together, and the suffixes that are packed at once.
BLOCK_BYTES = 1 << 21
PACKED = 1 << 20
#: Rows handed to a Python worker at once, texts or packed suffixes; Spark bounds their bytes.
BATCH_ROWS = 2000
#: Tasks that each language's best phrases are first found in.
SALTS = 64

#: Bytes that divide pieces, and those that divide words inside them.
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9]] = True

_SEPARATOR = pa.scalar(" ", pa.large_string())

#: Control characters, a zero that ends a spelled word among them, are written as DEL and a sign inside.
_ESCAPED = {c: f"\x7f{sign}" for c, sign in zip([*range(0, 9), *range(14, 32), 0x7F], "abcdefghijklmnopqrstuvwxyz0~", strict=True)}
_UNSAFE = np.zeros(256, dtype=bool)
_UNSAFE[list(_ESCAPED)] = True
#: In the name of a language blanks and line ends are written so too.
_ESCAPED_NAME = _ESCAPED | {c: f"\x7f{sign}" for c, sign in zip([0x20, *range(9, 14)], "123456", strict=True)}


def _plain(text: Column, escaped: dict[int, str]) -> Column:
    """The text that was escaped; DEL last, as it begins every sign."""
    out = text
    for c, sign in escaped.items():
        if c != 0x7F:
            out = F.replace(out, F.lit(sign), F.lit(chr(c)))
    return F.when(F.contains(text, F.lit("\x7f")), F.replace(out, F.lit(escaped[0x7F]), F.lit("\x7f"))).otherwise(text)


def _escape(texts: pa.Array) -> pa.Array:
    present = _UNSAFE[utf8(texts)[0]].any()
    return pa.array([t and t.translate(_ESCAPED) for t in texts.to_pylist()], pa.large_string()) if present else texts


def _numbered(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's number among them; without sorting where they are dense."""
    if below > 64 * (len(values) + 1):
        return np.unique(values, return_inverse=True)
    number = np.zeros(below, dtype=np.int64)
    number[values] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[values]


class Suffixes:
    """The words of a block of texts, numbered, with how far the piece of each reaches."""

    def __init__(self, langs: list[str | None], data: np.ndarray, at: np.ndarray):
        blank, stop = _BLANK[data], _BREAK[data]
        word = np.zeros(len(data) + 2, dtype=bool)
        word[1:-1] = ~(blank | stop)
        opens, closes = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        edges = at[(at > 0) & (at < len(data))]
        opens[edges] = word[1:-1][edges]
        closes[edges - 1] = word[1:-1][edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(at, starts, "right") - 1
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        held = data[word[1:-1]]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)]).dictionary_encode()
        names = [("und" if x is None else x).translate(_ESCAPED_NAME) for x in langs]
        self.langs = sorted(set(names))
        number = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([number[x] for x in names], dtype=np.int64)[row]
        # a word of a language: its number among those of the block
        pairs, self.word = _numbered(lang * max(1, len(words.dictionary)) + words.indices.to_numpy(), len(self.langs) * len(words.dictionary))
        self.of_lang, which = pairs // max(1, len(words.dictionary)), pairs % max(1, len(words.dictionary))
        self.text = words.dictionary.take(pa.array(which))
        self.hash = self._hashes()
        broken = np.concatenate([np.zeros(1, np.int32), np.cumsum(stop, dtype=np.int32)])
        same = (row[1:] == row[:-1]) & (broken[starts[1:]] == broken[ends[:-1]]) if len(starts) else np.zeros(0, bool)
        piece_ends = np.append(np.flatnonzero(~same) + 1, len(starts)) if len(starts) else np.zeros(0, np.int64)
        self.left = (piece_ends[np.searchsorted(piece_ends, np.arange(len(starts)), "right")] - np.arange(len(starts))) if len(starts) else np.zeros(0, np.int64)

    def _hashes(self) -> np.ndarray:
        """A hash of language and word, the same in every block."""
        data, at = utf8(self.spelled())
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        longest = int(np.diff(at).max(initial=0))
        powers = np.full(longest + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], out=prefix[1:])
        return mix(prefix[at[1:]] - prefix[at[:-1]])

    def spelled(self) -> pa.Array:
        """`lang word` of each distinct word."""
        return pc.binary_join_element_wise(pa.array(self.langs, pa.large_string()).take(pa.array(self.of_lang)), self.text, _SEPARATOR)

    def codes(self, vocabulary: tuple[np.ndarray, pa.Array]) -> tuple[np.ndarray, pa.Array]:
        """(code of each distinct word, the words spelled with a zero at the end)."""
        hashes, common = vocabulary
        own, found = self.spelled(), np.zeros(len(self.text), bool)
        at = np.minimum(np.searchsorted(hashes, self.hash), max(0, len(hashes) - 1))
        if len(hashes):
            found = (hashes[at] == self.hash) & pc.equal(common.take(pa.array(at)), own).to_numpy(zero_copy_only=False)
        return np.where(found, at + 1, SPELLED).astype(np.uint16), pc.binary_join_element_wise(own, pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string()))

    def prefix_hashes(self, depth: int) -> np.ndarray:
        """For each place the hash of its suffix's first words, at most `depth`; with fewer, of those and an end."""
        out = self.hash[self.word]
        for j in range(1, depth):
            nxt = np.zeros(len(out), dtype=np.uint64)
            nxt[: max(0, len(out) - j)] = self.hash[self.word[j:]]
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(self.left > j, nxt, np.uint64(j)))
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[Suffixes]:
    """The batch's (lang, text) rows in blocks, lower-cased."""
    langs = batch.column(0).to_pylist()
    data, offsets = utf8(_escape(batch.column(1)))
    for first, last in blocks(offsets, BLOCK_BYTES):
        at = offsets[first : last + 1] - offsets[first]
        yield Suffixes(langs[first:last], LOWER[data[offsets[first] : offsets[last]]], at)


_COUNTED = "lang string, word string, hash long, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n) of words; without lang and word, suffixes by bucket, its number as the hash."""
    held, size, loads = [], 0, np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for own in _blocks(batch):
            lang = pa.array(own.langs, pa.large_string()).take(pa.array(own.of_lang))
            n = np.bincount(own.word, minlength=len(own.text))
            held.append(pa.table([lang.cast(pa.string()), own.text.cast(pa.string()), pa.array(own.hash.view(np.int64)), pa.array(n)], names=["lang", "word", "hash", "n"]))
            loads += np.bincount(_bucket(own.prefix_hashes(2)[own.left > 1]), minlength=BUCKETS)
            size += held[-1].nbytes
            if size > HELD:
                yield from _added(held).to_batches()
                held, size = [], 0
    if held:
        yield from _added(held).to_batches()
    full = np.flatnonzero(loads)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.string()), pa.nulls(len(full), pa.string()), pa.array(full), pa.array(loads[full])], names=["lang", "word", "hash", "n"])


def _added(tables: list[pa.Table]) -> pa.Table:
    """Counted words, those of several blocks as one row."""
    found = pa.concat_tables(tables).group_by(["lang", "word", "hash"], use_threads=False).aggregate([("n", "sum")])
    return found.rename_columns(["lang", "word", "hash", "n"])


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


class Partition:
    """The group of each bucket, -1 for those over the budget; and the groups that the suffixes of these are dealt into."""

    def __init__(self, loads: np.ndarray, budget: int):
        over = loads > budget
        self.groups = _packed(np.where(over, 0, loads), budget)
        self.first_drawn = int(self.groups[-1]) + 1
        # filled by half, as all nodes of theirs are kept and dealing by hash is not even
        self.drawn = max(1, -(-2 * int(loads[over].sum()) // budget))
        self.groups[over] = -1


def _distinct(own: Suffixes, places: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of equal suffixes at the places, and how many there are: found by hash, and compared word by word."""
    _, first, kind, n = np.unique(own.prefix_hashes(DEPTH)[places], return_index=True, return_inverse=True, return_counts=True)
    after = [np.where(size > j, own.word[np.minimum(places + j, len(own.word) - 1)] + 1, 0) for j in range(DEPTH)]
    if all((x == x[first][kind]).all() for x in after):
        return first, n
    number = after[0]
    for x in after[1:]:
        number = np.unique(number * (len(own.text) + 1) + x, return_inverse=True)[1]
    return np.unique(number, return_index=True, return_counts=True)[1:]


def _slices(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary for each range of values between the offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())


def _pack(own: Suffixes, code: np.ndarray, spelled: pa.Array, places: np.ndarray, group: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each group of the places, which are in order of it."""
    at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    words, left = np.append(code[own.word], np.zeros(DEPTH, np.uint16)), own.left[places]
    codes = np.zeros((len(places), DEPTH), np.uint16)
    for j in range(DEPTH):
        codes[:, j] = words[places + j] * (left > j)
    long = np.flatnonzero(codes == SPELLED)
    data, ends = utf8(spelled.take(pa.array(own.word[places[long // DEPTH] + long % DEPTH])))
    columns = [pa.array(group[at[:-1]].astype(np.int32)), _slices(codes, at * DEPTH), _slices(data, ends[np.searchsorted(long, at * DEPTH)]), _slices(n, at)]
    return pa.RecordBatch.from_arrays(columns, names=["group", "codes", "spelled", "n"])


def _emit_suffixes(shared):
    """(group, codes, spelled, n): the suffixes of two words and more, a row for each block and group. A suffix is DEPTH codes and
    a number; words that are spelled out follow in the order of their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, vocabulary = shared.value
        for batch in batches:
            for own in _blocks(batch):
                places = np.flatnonzero(own.left > 1)
                if not len(places):
                    continue
                group = partition.groups[_bucket(own.prefix_hashes(2)[places])]
                n, over = np.ones(len(places), dtype=np.int32), group < 0
                if over.any():
                    drawn = places[over]
                    first, times = _distinct(own, drawn, np.minimum(own.left[drawn], DEPTH))
                    drawn = drawn[first]
                    dealt = partition.first_drawn + (own.prefix_hashes(DEPTH)[drawn] % np.uint64(partition.drawn)).astype(np.int32)
                    places, group, n = np.append(places[~over], drawn), np.append(group[~over], dealt), np.append(n[~over], times.astype(np.int32))
                order = np.argsort(group.astype(np.min_scalar_type(int(group.max()))), kind="stable")
                code, spelled = own.codes(vocabulary)
                for i in range(0, len(order), PACKED):
                    part = order[i : i + PACKED]
                    yield _pack(own, code, spelled, places[part], group[part], n[part])

    return run


def _subtrees(shared, least: int):
    """(phrase, words, n) of the nodes of a group's suffixes; n is whole, or a part where the node may go on elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        partition, (_, common) = shared.value
        drawn = table.column("group")[0].as_py() >= partition.first_drawn
        codes = _joined(table.column("codes")).view(np.uint16).astype(np.int32)
        n = _joined(table.column("n")).view(np.int32)
        data = _joined(table.column("spelled"))
        ends = np.append(0, np.flatnonzero(data == 0) + 1)
        long = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        codes[codes == SPELLED] = SPELLED + 1 + long.indices.to_numpy()
        codes = codes.reshape(-1, DEPTH)
        below, rows, node, found = SPELLED + 1 + len(long.dictionary), np.arange(len(codes)), codes[:, 0].astype(np.int64), []
        for depth in range(2, DEPTH + 1):
            going = codes[rows, depth - 1] > 0
            rows, node = rows[going], node[going]
            distinct, node = np.unique(node * below + codes[rows, depth - 1], return_inverse=True)
            total = np.bincount(node, weights=n[rows], minlength=len(distinct)).astype(np.int64)
            keep = np.ones(len(distinct), bool) if drawn and depth < DEPTH else total >= least
            one = np.zeros(len(distinct), np.int64)
            one[node] = rows
            found.append((codes[one[keep], :depth], total[keep]))
            rows, node = rows[keep[node]], node[keep[node]]
        return pa.concat_tables([_phrases(c, common, long.dictionary, total) for c, total in found])

    return run


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a binary column, one after another."""
    held = column.cast(pa.large_binary()).combine_chunks()
    at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _phrases(codes: np.ndarray, common: pa.Array, long: pa.Array, n: np.ndarray) -> pa.Table:
    """(phrase, words, n): a phrase is `lang word word ...`."""
    distinct, which = np.unique(codes, return_inverse=True)
    short = distinct <= SPELLED
    named = pa.concat_arrays([common.take(pa.array(distinct[short] - 1)), pc.utf8_rtrim(long.take(pa.array(distinct[~short] - SPELLED - 1)), characters="\0")])
    bare = pc.replace_substring_regex(named, "^[^ ]* ", "")
    which = which.reshape(codes.shape)
    parts = [(bare if j else named).take(pa.array(which[:, j])) for j in range(codes.shape[1])]
    phrase = pc.binary_join_element_wise(*parts, _SEPARATOR)
    return pa.table([phrase.cast(pa.string()), pa.array(np.full(len(n), codes.shape[1], np.int32)), pa.array(n)], names=["phrase", "words", "n"])


def _packed(loads: np.ndarray, budget: int) -> np.ndarray:
    """The group of each bucket: buckets in turn, a new group when the last is full."""
    groups, group, held = np.zeros(len(loads), dtype=np.int32), 0, 0
    for i, load in enumerate(loads.tolist()):
        if held and held + load > budget:
            group, held = group + 1, 0
        groups[i] = group
        held += load
    return groups


def _collect(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    found = rows.select(*columns).toArrow()
    return [found.column(c).to_numpy() for c in columns]


def _common(words: DataFrame) -> tuple[np.ndarray, pa.Array]:
    """Hashes, in order, and spellings `lang word` of the most frequent words; of words with one hash, one."""
    top = words.orderBy(F.desc("n"), "hash").limit(COMMON).select("hash", F.concat_ws(" ", "lang", "word").alias("spelled")).toArrow()
    hashes, first = np.unique(top.column("hash").to_numpy().view(np.uint64), return_index=True)
    return hashes, top.column("spelled").combine_chunks().cast(pa.large_string()).take(pa.array(first))


def phrase_counts(docs: DataFrame, least: int, groups: int = GROUPS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of at most DEPTH words with f >= least, (lang, n)); control characters are escaped."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    counted = texts.mapInArrow(_count_words, _COUNTED).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words", BATCH_ROWS)
    words = counted.filter("lang is not null")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at, load = _collect(counted.filter("lang is null"), "hash", "n")
    loads = np.zeros(BUCKETS, dtype=np.int64)
    loads[at] = load
    partition = Partition(loads, max(1, min(MOST, -(-total // groups))))
    shared = docs.sparkSession.sparkContext.broadcast((partition, _common(words)))
    suffixes = texts.mapInArrow(_emit_suffixes(shared), "group int, codes binary, spelled binary, n binary")
    nodes = suffixes.groupBy("group").applyInArrow(_subtrees(shared, least), "phrase string, words int, n long")
    counts = nodes.groupBy("phrase", "words").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    lang = F.substring_index("phrase", " ", 1)
    counts = counts.select(lang.alias("lang"), F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "words", "f")
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return materialize(counts.unionByName(single), "phrases", BATCH_ROWS), totals


def exact_score() -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    a, l, r, n = (f"cast({c} as decimal(17,0))" for c in "alrn")
    return F.expr(f"(1000bd * {a} * {n}) div ({l} * {r})").cast("long")


def collocations(docs: DataFrame, least: int = 100, best: int | None = 2000, groups: int = GROUPS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's phrases by score: lang, rank, phrase, a, l, r, n, score; with `best`, its first ones only."""
    counts, totals = phrase_counts(docs, least, groups, lang_col, text_col)
    candidates = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")))
    parts = materialize(cut.select("lang", "phrase", "words", F.col("f").alias("a"), "k", F.inline(sides)), "parts")
    used = parts.groupBy("lang", "part").count().withColumnRenamed("count", "n")
    keyed = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")).join(used, ["lang", "part"])
    joined = materialize(join_counted(parts, keyed, ["lang", "part"], parts.count()), "joined")

    # a shorter phrase of which a longer one by a word occurs as often
    one_shorter = (F.col("words") > 2) & (((F.col("side") == "l") & (F.col("k") == F.col("words") - 1)) | ((F.col("side") == "r") & (F.col("k") == 1)))
    inside = joined.filter(one_shorter & (F.col("a") == F.col("part_f"))).select("lang", F.col("part").alias("phrase")).distinct()

    cuts = joined.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"))
    sizes = cuts.groupBy("lang").count().withColumnRenamed("count", "n")
    cuts = join_counted(cuts, totals.withColumnRenamed("n", "words_n").join(sizes, "lang"), ["lang"], cuts.count()).withColumnRenamed("words_n", "n")
    scored = cuts.withColumn("score", exact_score()).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("c")).select("lang", "phrase", "c.*")
    scored = scored.join(inside, ["lang", "phrase"], "left_anti")
    spelled = scored.select(_plain(F.col("lang"), _ESCAPED_NAME).alias("lang"), _plain(F.col("phrase"), _ESCAPED).alias("phrase"), "a", "l", "r", "n", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if best is not None:
        salted = spelled.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        spelled = salted.withColumn("first", first).filter(F.col("first") <= best).drop("salt", "first")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = spelled.withColumn("rank", rank)
    return (ranked if best is None else ranked.filter(F.col("rank") <= best)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with p as materialized (select lang, row_number() over () as piece, w from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents) s) t),
tot as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
f as materialized (select lang, size, phrase, count(*) as f from (
  select lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) as phrase from p, (select unnest([1, 2, 3, 4, 5]) as size) z where len(w) >= size) g
  group by lang, size, phrase having count(*) >= 100),
cut as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from f where size > 1),
two as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, n, cast(1000::hugeint * c.a * n // (x.f::hugeint * y.f) as bigint) as score
  from cut c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 :], ' ') join tot on tot.lang = c.lang),
low as (select * from two qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from low where not exists (select 1 from f g where g.lang = low.lang and g.f >= low.a and g.phrase <> low.phrase and contains(' ' || g.phrase || ' ', ' ' || low.phrase || ' ')))
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept) k where rank <= 2000
"""

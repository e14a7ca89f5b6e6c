"""Passage deduplication: repeated passages of at least `min_words` words, wherever lines begin and end.

A document is the sequence of its words (runs without white space, as `str.split` finds them). A word is
deleted exactly if it lies in a run of `min_words` words that occurred before: in a document of smaller id,
or ended in the same one before it began, so a run that repeats into itself stays whole once. Line breaks
count as any white space.

Runs of `min_words` words are found by winnowing. The grams of a third of that length inside a run are hashed
and the least one, the last of equal ones, owns the run. Runs with the same words have equal owners, so:

1. Each owner is one row, (hash, hash of all words of the runs it owns, id, first word, last word), about one
   for 18 words. Owners whose hash occurs once are dropped after pre-aggregation.
2. Owners that agree in all words of their runs form a group; all but its first occurrence are repeats.
3. Where one hash has several groups (edges of passages, mostly), the first of each group is taken apart into
   its single runs, and a run that occurred before is a repeat; so are those that overlap the first in its own
   document, fewer than `min_words` in all. Others of a group need not be looked at: their runs are repeats
   already, and the first one stands before them.

Rows are only ever grouped with map-side aggregation and joined with their first occurrence, never with each
other; keys that hold a thousandth of all rows or more meet it by broadcast, so that no task gets all their rows. Words are told apart by 64-bit hashes, runs by two such hashes.

A deleted passage takes one of the gaps around it along: the one with fewer line breaks, or the one after it
where both have as many; at the start of a text the one after it, at its end the one before.

Defined results: null texts count as empty and stay null; of repeated rows (one id, one text) all count as one
place, so they do not delete each other's words and lose the same ones; rows with a null id are returned
unchanged; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize
from .text_arrays import NOT_SPACE, blocks, mix, range_hashes, utf8, word_bounds, word_hashes

MIN_WORDS = 50

_WORD = NOT_SPACE.copy()
_WORD[0x1C:0x20] = False
_SALT = np.uint64(0xA24BAED4963EE407)
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.int64)


def _spaced(data: np.ndarray) -> np.ndarray:
    """The bytes with every character of white space beyond ASCII as spaces."""
    data = data.copy()
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[np.isin(data[at + 1], (0x85, 0xA0))]
    data[at] = data[at + 1] = 0x20
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
    at = at[np.isin(code, _WIDE_SPACES)]
    data[at] = data[at + 1] = data[at + 2] = 0x20
    return data


def _word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, last row, their bytes and offsets, starts and ends of words, first word of each row."""
    data, offsets = utf8(texts)
    for first, last in blocks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        yield first, last, part, at, *word_bounds(_spaced(part), at, _WORD)


def last_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of the least one, the last of equal ones."""
    if len(values) < width:
        return np.zeros(0, np.int64)

    def joined(value: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        later = value[step:] <= value[:-step]
        return np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])

    value, place, size = values, np.arange(len(values)), 1
    while 2 * size <= width:
        value, place = joined(value, place, size)
        size *= 2
    return joined(value, place, width - size)[1] if size < width else place


def owners(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of all words of its runs, row, start and end (exclusive, both among the words of the row) of each owner."""
    gram = max(1, min_words // 3)
    begins = np.arange(max(0, len(words) - gram + 1))
    hashes = range_hashes(words, begins, begins + gram)
    owner = last_least(hashes, min_words - gram + 1)
    row = np.searchsorted(first, np.arange(len(owner)), "right") - 1
    runs = np.flatnonzero(np.arange(len(owner)) + min_words <= first[row + 1])
    new = np.ones(len(runs), bool)
    new[1:] = owner[runs][1:] != owner[runs][:-1]
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(runs))[: len(opens)] - 1
    start, end = runs[opens], runs[closes] + min_words
    keys = range_hashes(mix(words ^ _SALT), start, end)
    base = first[row[start]]
    return hashes[owner[start]], keys, row[start], start - base, end - base


def _owner_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, _, data, _, starts, ends, first in _word_blocks(batch.column(1)):
                prints, keys, row, start, end = owners(word_hashes(data, starts, ends), first, min_words)
                order = np.lexsort((start, keys, row))
                a, b = order[:-1], order[1:]
                near = np.zeros(len(order), bool)  # an equal owner of the same document begins less than min_words before
                near[b] = (row[a] == row[b]) & (keys[a] == keys[b]) & (start[b] - start[a] < min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(row + top)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(near)],
                    names=["print", "key", "id", "start", "end", "near"],
                )

    return run


def _single_runs(min_words: int):
    """The single runs of the owners given for each document: (print, run, id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, last, data, _, starts, ends, first in _word_blocks(batch.column(1)):
                given = batch.column(2).slice(top, last - top)
                row = np.repeat(np.arange(last - top), given.value_lengths().to_numpy(zero_copy_only=False))
                prints, begin, end = (x.to_numpy(zero_copy_only=False) for x in given.flatten().flatten())
                many = end.astype(np.int64) - begin - min_words + 1
                row, prints = np.repeat(row, many), np.repeat(prints, many)
                begin = np.repeat(begin.astype(np.int64), many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at = first[row] + begin
                runs = range_hashes(mix(word_hashes(data, starts, ends) ^ _SALT), at, at + min_words)
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(runs.view(np.int64)), batch.column(0).take(pa.array(row + top)), pa.array(begin.astype(np.int32))], names=["print", "run", "id", "start"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, runs): the repeated passages of each document that has any, as (start, end) among its words; they may overlap."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_owner_rows(min_words), f"print long, key long, id {kind}, start int, end int, near boolean"), "owners")
    often = materialize(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = materialize(join_counted(prints, often, ["print"], prints.count()), "shared")
    total = shared.count()
    groups = shared.groupBy("print", "key").agg(F.min(F.struct("id", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("near").alias("near"))
    groups = materialize(groups, "groups")
    after = (F.col("id") > F.col("first.id")) | (F.col("start") >= F.col("first.start") + min_words)
    whole = join_counted(shared, groups.where("n > 1").select("print", "key", "first", "n"), ["print", "key"], total).where(after).select("id", "start", "end")

    several = groups.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    overlapping = join_counted(shared.where("near"), groups.where("near").select("print", "key", "first", "n"), ["print", "key"], total).where(~after & (F.col("start") > F.col("first.start")))
    firsts = groups.select("print", "first.*").union(overlapping.select("print", "id", "start", "end"))
    apart = firsts.join(several, "print").groupBy("id").agg(F.collect_list(F.struct("print", "start", "end")).alias("given"))
    single = rows.join(apart, "id").select("id", "text", "given").mapInArrow(_single_runs(min_words), f"print long, run long, id {kind}, start int")
    single = materialize(single, "single")
    first = materialize(single.groupBy("print", "run").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    part = join_counted(single, first, ["print", "run"], single.count()).where(after).select("id", "start", (F.col("start") + min_words).alias("end"))
    return whole.union(part).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words marked, which are given by their bounds, and without one gap beside each run of them."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    pieces, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        before, after = ends[a - 1] if a else 0, starts[b] if b < len(starts) else len(text)
        left, right = text[before : starts[a]], text[ends[b - 1] : after]
        keep_right = a and (b == len(starts) or right.count(b"\n") > left.count(b"\n"))
        pieces += [text[at:before], right if keep_right else left]
        at = after
    return b"".join([*pieces, text[at:]])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for top, last, data, at, starts, ends, first in _word_blocks(batch.column(1)):
            n, rows = len(starts), last - top
            given = batch.column(2).slice(top, rows)
            row = np.repeat(np.arange(rows), np.nan_to_num(given.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            begin, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in given.flatten().flatten())
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, first[row] + begin, 1)
            np.add.at(edge, first[row] + end, -1)
            gone = np.cumsum(edge)[:n] > 0

            breaks = np.cumsum(data == 10)[starts]
            opens = np.ones(n, bool)
            opens[1:] = breaks[1:] != breaks[:-1]
            opens[first[:-1][np.diff(first) > 0]] = True
            line = np.cumsum(opens) - 1
            lines = int(line[-1]) + 1 if n else 0
            of = np.repeat(np.arange(rows), np.diff(first))
            lost = np.bincount(line[~gone], minlength=lines) == 0
            texts = batch.column(1).slice(top, rows).to_pylist()
            for i in np.unique(row):
                own = slice(first[i], first[i + 1])
                texts[i] = _cut(data[at[i] : at[i + 1]].tobytes(), starts[own] - at[i], ends[own] - at[i], gone[own]).decode()
            counts = [np.bincount(of[opens], minlength=rows), np.bincount(of[opens][lost], minlength=rows), np.bincount(of[gone], minlength=rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(top, rows), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in counts)], names=["id", "text", "n_lines", "n_removed", "words_removed"])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, text without repeated passages, n_lines (with words), n_removed (lines that lost all words), words_removed."""
    kind = docs.schema[id_col].dataType.simpleString()
    runs = repeated_passages(docs, id_col, text_col, min_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(runs, "id", "left").select("id", "text", "runs")
    return rows.mapInArrow(_without, f"id {kind}, text string, n_lines long, n_removed long, words_removed long").withColumnsRenamed({"id": id_col, "text": text_col})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (" ".join((text or "").split()).encode() for text in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string())], names=[*batch.schema.names[:-1], "words_sha256"])


def digest(found: DataFrame) -> DataFrame:
    """The last column, a text, as the SHA-256 (lowercase hex) of its words with one space between them; null is as empty."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema[:-1]]
    return found.mapInArrow(_digests, ", ".join([*kinds, "words_sha256 string"]))


#: White space between words, as a class of both Java's and DuckDB's patterns.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ORACLE = rf"""
with lines as (select doc_id, unnest(range(1, len(ls) + 1)) as li, ls from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d),
lw as (select doc_id, li, regexp_extract_all(ls[li], '[^{SPACE}]+') as ws from lines),
word as materialized (select *, row_number() over (partition by doc_id order by li, k) as i from (select doc_id, li, unnest(range(1, len(ws) + 1)) as k, unnest(ws) as w from lw) x),
seq as materialized (select doc_id, list(w order by i) as ws from word group by doc_id),
run as materialized (select doc_id, i, md5(array_to_string(ws[i : i + {MIN_WORDS} - 1], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - {MIN_WORDS} + 2)) as i from seq) x),
head as (select h, min((doc_id, i)) as f from run group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + {MIN_WORDS})) as i from run join head using (h) where doc_id > f[1] or i >= f[2] + {MIN_WORDS}),
line as (select doc_id, li, count(*) as n, count(g.i) as lost from word left join gone g using (doc_id, i) group by doc_id, li),
per as (select doc_id, count(*) as n_lines, count(*) filter (where n = lost) as n_removed, sum(lost)::bigint as words_removed from line group by doc_id),
rest as (select doc_id, string_agg(w, ' ' order by i) as words from word anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(words_removed, 0) as words_removed, sha256(coalesce(words, '')) as words_sha256
from documents left join per using (doc_id) left join rest using (doc_id)
"""

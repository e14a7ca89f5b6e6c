"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of each document.

Each document is encoded whole by both. Its tokens get byte ranges; pandas `merge_asof`, per batch and keyed
by document, finds for each token start the other side's covering token. The union of both directions
is all overlaps. Overlaps whose tokens end together are links, and their ends cut a document into groups,
the smallest spans that both sides cover with whole tokens.

Two passes, as the counts of id pairs are corpus-wide. The first writes a row per document with its
distinct linked pairs and how often each occurs. The counts are summed by Spark. The second looks them up:
the most frequent pairs, at most `MOST_PAIRS` of them at any size, are sent to the tasks, and only what
is left of a document's pairs, the rare ones, is joined by shuffle. So nothing sent grows with the data,
and no key of the join holds more than a small share of the rows.

For the second tokenizer a text is cut before each single space that stands between other characters, where it
begins a token whatever comes next to it (checked against its vocabulary, else texts are not cut); pieces that
a task has encoded are remembered, within a bound. Results are those of whole texts (tested).

Defined results: null and empty texts, and texts whose tokens do not join to the text's bytes in either
encoding, have no tokens: zeros, and an empty digest. Repeated rows and null ids are each returned. An
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text_arrays import blocks, utf8

#: Bytes of text aligned at a time; a longer text makes a block of its own.
ALIGNED_BYTES = 1 << 21
#: Pieces whose tokens a task remembers; they are forgotten when there are more.
REMEMBERED = 1 << 18
#: Pairs that are looked up in the tasks, about 17 bytes each.
MOST_PAIRS = 1 << 20

_SPACE = 0x20

def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of `data` one after another, and their offsets there."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


class _Side:
    """One tokenizer: the bytes of each id, and its decimal digits."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        # ids in decimal, up to seven digits, as the low bytes of a number
        digits = [b"%d" % i for i in range(len(pieces))]
        self.digit_sizes = np.array([len(d) for d in digits], dtype=np.int64)
        self.digits = np.array(digits, dtype="S8").view("<u8")

    def tokens(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, texts that begin with a space, one after another, and each row's offsets there."""
        raise NotImplementedError


class _ByteLevel(_Side):
    """A byte-level BPE. Its file's merges stand in the order of their ids, so ids serve as ranks (checked)."""

    #: How such tokenizers divide a text before merging; fixed.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        # byte-level names write each byte as one character: printable ones as themselves, the others from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {t["content"] for t in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in name): i for name, i in held["model"]["vocab"].items() if name not in special}
        joined = [ranks["".join(m if isinstance(m, list) else m.split(" ")).translate({ord(c): b for c, b in byte_of.items()}).encode("latin-1")] for m in held["model"]["merges"]]
        if joined != sorted(joined):
            raise ValueError("the merges are not in the order of their ids")
        self.model = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        super().__init__(pieces)

    def tokens(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, ids = data.tobytes(), [np.zeros(0, np.uint32)]
        ids += [self.model.encode_to_numpy(text[x:y].decode(), disallowed_special=()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.concatenate(ids).astype(np.int64), np.cumsum([len(own) for own in ids])


class _Pieces(_Side):
    """A piece model with byte fallback. What a piece of text was encoded to is remembered within a bound."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # texts may be cut before a space after another character if no piece crosses such a place
        self.cuts = not any("▁" in n.lstrip("▁") for i, n in enumerate(names) if not self.model.is_control(i))
        self.forget()
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def forget(self) -> None:
        self.known, self.ids, self.ends = {}, array("i"), array("q", [0])

    def tokens(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = _pieces_of(data, at) if self.cuts else np.unique(at)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        texts, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.forget()
        found = np.array([self.known.get(t, -1) for t in texts], dtype=np.int64)
        fresh = np.flatnonzero(found < 0)
        found[fresh] = len(self.known) + np.arange(len(fresh))
        new = [texts[i] for i in fresh.tolist()]
        self.known.update(zip(new, found[fresh].tolist(), strict=True))
        for own in self.model.encode([t[1:] for t in new], num_threads=1):  # the model adds the space
            self.ids.extend(own)
            self.ends.append(len(self.ids))
        ends = np.array(self.ends)[np.concatenate([found, found + 1])].reshape(2, -1)
        ids, ends = _gather(np.array(self.ids, dtype=np.int64), ends[0][which], (ends[1] - ends[0])[which])
        return ids, ends[np.searchsorted(cuts, at)]


@lru_cache(maxsize=2)
def _sides(byte_level: str, pieces: str) -> tuple[_Side, _Side]:
    return _ByteLevel(byte_level), _Pieces(pieces)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with a space in front; empty rows stay empty."""
    sizes = np.diff(offsets)
    made = np.where(sizes > 0, sizes + 1, 0)
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.full(at[-1], _SPACE, dtype=np.uint8)
    out[np.repeat(at[:-1] + 1 - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    return out, at


def _pieces_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of the pieces that are encoded apart; rows' offsets are among them."""
    inner = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        inner[1:-2] = (data[1:-1] == _SPACE) & (data[:-2] != _SPACE) & (data[2:] != _SPACE)
    inner[at] = True
    return np.flatnonzero(inner)


def _joins(side: _Side, ids: np.ndarray, tokens_at: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, whether its tokens' bytes are the row's bytes."""
    ends = np.concatenate([[0], np.cumsum(side.sizes[ids])])
    own = np.diff(ends[tokens_at]) == np.diff(at)
    if own.all():
        made = side.data[np.repeat(side.begin[ids] - ends[:-1], side.sizes[ids]) + np.arange(ends[-1])]
        wrong = np.flatnonzero(made != data)
        own[np.searchsorted(at, wrong, "right") - 1] = False
        return own
    for i in np.flatnonzero(own):
        mine = ids[tokens_at[i] : tokens_at[i + 1]]
        own[i] = _gather(side.data, side.begin[mine], side.sizes[mine])[0].tobytes() == data[at[i] : at[i + 1]].tobytes()
    return own


def _frame(side: _Side, name: str, ids: np.ndarray, tokens_at: np.ndarray, at: np.ndarray, good: np.ndarray) -> pd.DataFrame:
    """Tokens of the good rows: document, start and end as places in the block, number of the token, id."""
    document = np.repeat(np.arange(len(at) - 1), np.diff(tokens_at))
    keep = good[document]
    ids, document = ids[keep], document[keep]
    ends = np.cumsum(side.sizes[ids])
    starts = ends - side.sizes[ids]
    counts = np.bincount(document, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    shift = np.zeros(len(at) - 1, dtype=np.int64)
    has = counts > 0
    shift[has] = at[:-1][has] - starts[first[has]]
    return pd.DataFrame({"document": document, "start": starts + shift[document], f"{name}_end": ends + shift[document], name: np.arange(len(ids)), f"{name}_id": ids})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs (a, b) of tokens that share a byte, in order: each start is looked up among the other side's, and the finds are united.

    A start is a place in the block, so it names its document too, and a document's first start is on both sides.
    """
    a, b = a[["start", "a"]], b[["start", "b"]]
    to_b, to_a = pd.merge_asof(a, b, on="start"), pd.merge_asof(b, a, on="start")
    # a start that both sides have is found in both directions
    places = np.concatenate([to_b["a"].to_numpy() * len(b) + to_b["b"].to_numpy(), to_a["a"].to_numpy() * len(b) + to_a["b"].to_numpy()])
    places.sort()
    places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
    return pd.DataFrame({"a": places // max(1, len(b)), "b": places % max(1, len(b))})


def _written(side: _Side, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digits and the mark behind them in the low bytes, used bytes) of each token."""
    sizes = side.digit_sizes[ids]
    return side.digits[ids] | (marks.astype(np.uint64) << (8 * sizes).astype(np.uint64)), sizes + 1


def _digests(sides: tuple[_Side, _Side], a: pd.DataFrame, b: pd.DataFrame, a_last: np.ndarray, b_last: np.ndarray, n: int) -> list[str]:
    """SHA-256 per document of `a1,a2|b1;a3|b2,b3`; a_last and b_last mark tokens that end a group."""
    groups_a = np.concatenate([[0], np.cumsum(a_last)[:-1]]) if len(a) else np.zeros(0, np.int64)
    groups_b = np.concatenate([[0], np.cumsum(b_last)[:-1]]) if len(b) else np.zeros(0, np.int64)
    text_a, size_a = _written(sides[0], a["a_id"].to_numpy(), np.where(a_last, ord("|"), ord(",")))
    text_b, size_b = _written(sides[1], b["b_id"].to_numpy(), np.where(b_last, ord(";"), ord(",")))
    order = np.argsort(np.concatenate([groups_a * 2, groups_b * 2 + 1]), kind="stable")
    text, size = np.concatenate([text_a, text_b])[order], np.concatenate([size_a, size_b])[order]
    document = np.concatenate([a["document"].to_numpy(), b["document"].to_numpy()])[order]
    flat = text.view(np.uint8).reshape(-1, 8)[np.arange(8) < size[:, None]].tobytes()
    lengths = np.bincount(document, weights=size, minlength=n).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def align_block(sides: tuple[_Side, _Side], data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
    """Counts, digests, and distinct linked pairs (code a * size of b + b, times) per row of a block of texts."""
    n = len(offsets) - 1
    text, at = _spaced(data, offsets)
    encoded = [side.tokens(text, at) for side in sides]
    good = np.diff(at) > 0
    for side, (ids, tokens_at) in zip(sides, encoded, strict=True):
        good &= _joins(side, ids, tokens_at, text, at)
    a, b = (_frame(side, name, ids, tokens_at, at, good) for side, name, (ids, tokens_at) in zip(sides, "ab", encoded, strict=True))
    over = overlaps(a, b)
    a_end, b_end, document = a["a_end"].to_numpy(), b["b_end"].to_numpy(), a["document"].to_numpy()
    la, lb = over["a"].to_numpy(), over["b"].to_numpy()
    ends = a_end[la] == b_end[lb]
    la, lb = la[ends], lb[ends]
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[la] = b_last[lb] = True
    per = lambda x: np.bincount(x, minlength=n).astype(np.int64)
    codes = len(sides[0].sizes) * len(sides[1].sizes)
    keys, times = np.unique(document[la] * codes + a["a_id"].to_numpy()[la] * len(sides[1].sizes) + b["b_id"].to_numpy()[lb], return_counts=True)
    return {
        "n_a": per(document),
        "n_b": per(b["document"].to_numpy()),
        # a group ends where tokens of both sides do
        "n_groups": np.bincount(document, weights=a_last, minlength=n).astype(np.int64),
        "n_links": per(document[la]),
        "n_overlaps": per(document[over["a"].to_numpy()]),
        "groups_sha256": _digests(sides, a, b, a_last, b_last, n),
        "pairs": (np.concatenate([[0], np.cumsum(per(keys // codes))]), keys % codes, times),
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _align(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_level, pieces)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in blocks(offsets, ALIGNED_BYTES):
                own = align_block(sides, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                at, codes, times = own["pairs"]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (codes, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *[pa.array(own[c]) for c in _COUNTS], pa.array(own["groups_sha256"], pa.string()), *lists], names=["id", *_COUNTS, "groups_sha256", "codes", "times"])

    return run


def _look_up(frequent):
    """Sums over the frequent pairs of each row; the other pairs stay in the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = frequent.value
        for batch in batches:
            lists = batch.column("codes")
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            found = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[found], times[found] * counts[at[found]])
            np.add.at(bests, row[found], times[found] * best[at[found]])
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x)) for x in (own[~found], times[~found].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bests), pa.array(sums), *rest], names=["row", "n_best", "count_sum", "codes", "times"])

    return run


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(code, count, best) over the corpus: how many links hold an id pair, and whether it is the highest of its B id."""
    pairs = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("count"))
    pairs = materialize(pairs.withColumn("b", F.col("code") % size_b), "pair-counts")
    most = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("most")))  # a row per id of B's vocabulary
    return pairs.join(most, "b").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256.

    `byte_level` and `pieces` are files of a byte-level BPE and of a piece model with byte fallback, at
    the same path on every executor.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    size_b = len(_sides(byte_level, pieces)[1].sizes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_align(byte_level, pieces), f"id {kind}, {counts}, groups_sha256 string, codes array<long>, times array<int>")
    aligned = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = materialize(pair_counts(aligned, size_b), "pairs")
    # the frequent pairs are those of at least 2^e links, e the least that leaves no more than MOST_PAIRS
    power = F.floor(F.log2("count")).cast("int")
    sizes = {r.power: r.n for r in pairs.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = next((e for e in range(65) if sum(n for p, n in sizes.items() if p >= e) <= MOST_PAIRS))
    top = pairs.filter(power >= least).select("code", "count", "best").toArrow()
    order = np.argsort(top.column("code").to_numpy())
    frequent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("code", "count", "best")))
    looked = aligned.select("row", "codes", "times").mapInArrow(_look_up(frequent), "row long, n_best long, count_sum long, codes array<long>, times array<int>")
    if not any(p < least for p in sizes):
        sums = looked.select("row", "n_best", "count_sum")
    else:
        looked = materialize(looked, "looked-up")
        rare = looked.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").cast("long").alias("times"))
        rare = rare.join(pairs.filter(power < least), "code").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
        sums = looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("codes", "times").join(sums, "row").select(F.col("id").alias(id_col), *_COUNTS, "n_best", "count_sum", "groups_sha256")

"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed subwords (byte 2- to 4-grams inside words, with
a blank on either side of a word, and whole words); a linear layer and softmax give the languages.
Embeddings and layer are trained here by stochastic gradient descent in numpy, on a bounded sample
of labelled rows: about `per_language` rows of each language, fewer where there are over `sample_rows`
in all or their subword counts would take more than `sample_bytes`, chosen by a hash of ids and texts.
Executors turn the sampled texts, whole, into sparse counts of all their subwords, which the driver
trains on; a text has at most BUCKETS of them, 8 bytes each, whatever its length.

A fifth of the sample is set aside to calibrate. A temperature of at least 1 makes the top probability
honest. A text is rejected for either of two reasons. Its score is too near chance: `margin` of the way
from 1/languages to 1, or the score that `reject_rate` of the set-aside rows fall under (their least,
where they are too few for that) if that is lower. Or too few of its subwords are known from training:
less than half way from the share that any text has by hash collisions to the share of set-aside rows,
or what `reject_rate` of them fall under if that is lower; this also works with one or two languages.
Unknown subwords count as zero. Prediction reads whole texts. As averaging and the linear layer commute,
executors get one table of BUCKETS x languages (1 MB a language).

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without
any labelled row everything is `und`; rows with null labels are predicted but not learned from;
repeated rows are each given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrays import blocks, utf8, word_bounds, word_hashes

BUCKETS = 1 << 18
DIMENSIONS = 16
GRAMS = (2, 3, 4)
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: each subword's part of the logits
    bias: np.ndarray
    temperature: float
    threshold: float
    known: np.ndarray  # which buckets were seen in training
    least_known: float  # a smaller share of known subwords is rejected

    def share_known(self, buckets: np.ndarray) -> float:
        return float(np.count_nonzero(self.known[buckets])) / max(1, len(buckets))

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        total, step = np.zeros(len(self.languages)), max(1, (1 << 18) // len(self.languages))
        for at in range(0, len(buckets), step):
            total += self.table[buckets[at : at + step]].sum(axis=0, dtype=np.float64)
        return (total / max(1, len(buckets)) + self.bias) / self.temperature


def subwords(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the hash buckets of all its subwords."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, offsets = utf8(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), lower, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
    for first, last in blocks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        letter = _LETTER[part]
        plain = np.where(letter, part, 32).astype(np.uint32)
        found, place = [], []
        for n in GRAMS:
            size = len(plain) - n + 1
            if size <= 0:
                continue
            valid = letter[1 : 1 + size].copy() if n > 2 else letter[:size] | letter[1 : 1 + size]
            gram = plain[:size] | (plain[1 : 1 + size] << np.uint32(8))
            for j in range(2, n):
                gram |= plain[j : j + size] << np.uint32(8 * j)
                if j < n - 1:
                    valid &= letter[j : j + size]
            keep = np.flatnonzero(valid)
            found.append((((gram[keep] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32))
            place.append(np.searchsorted(keep, at))
        starts, ends, words = word_bounds(part, at, _LETTER)
        found.append((word_hashes(part, starts, ends) >> np.uint64(46)).astype(np.int32))
        place.append(words)
        for i in range(last - first):
            yield np.concatenate([x[p[i] : p[i + 1]] for x, p in zip(found, place, strict=True)])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for buckets in subwords(batch.column(1)):
            own, counts = np.unique(buckets, return_counts=True)
            at.append(own.astype(np.int32).tobytes())
            n.append(counts.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "turn", "at", "n"])


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = 300,
    sample_rows: int = 20_000,
    sample_bytes: int = 1 << 30,
    epochs: int = 12,
    reject_rate: float = 0.001,
    margin: float = 0.13,
    seed: int = 7,
) -> Model:
    """Train on a bounded sample of the labelled rows of docs."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("turn"))
    labelled = labelled.filter("lang is not null and text is not null")
    # each byte begins a gram of each length and a word at most, so these are upper bounds of the counts' bytes
    most = F.least(F.lit(8 * BUCKETS), 8 * (len(GRAMS) + 1) * F.octet_length("text"))
    sizes = {r.lang: (r.rows, r.bytes) for r in labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(most).alias("bytes")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0, np.zeros(BUCKETS, bool), 0.0)
    per_language = min(per_language, sample_rows // len(languages))
    wanted = {lang: max(2, min(per_language, sample_bytes // len(languages) * rows // max(1, size))) for lang, (rows, size) in sizes.items()}
    below = F.create_map(*[F.lit(x) for lang in languages for x in (lang, wanted[lang] / sizes[lang][0])])
    sample = labelled.filter(F.col("turn") < F.try_element_at(below, F.col("lang"))).select("lang", "text", "turn")
    # repeated rows have one turn, so the filter alone does not bound them
    sample = sample.orderBy("turn", "lang").limit(2 * sum(wanted.values()))
    rows = sorted(sample.mapInArrow(_sparse, "lang string, turn double, at binary, n binary").collect(), key=lambda r: (r.turn, r.lang, r.at, r.n))
    code = {lang: i for i, lang in enumerate(languages)}
    data = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32), code[r.lang]) for r in rows if len(r.at)]
    data = [(at, n / n.sum(), y) for at, n, y in data]
    held = [x for i, x in enumerate(data) if i % 5 == 0] or data
    used = [x for i, x in enumerate(data) if i % 5] or data
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for i in rng.permutation(len(used)):
            at, weight, y = used[i]
            hidden = weight @ embed[at]
            error = -_softmax(hidden @ layer + bias)
            error[y] += 1
            back = layer @ error
            layer += rate * np.outer(hidden, error).astype(np.float32)
            bias += 0.01 * rate * error.astype(np.float32)
            embed[at] += (rate * weight[:, None] * back).astype(np.float32)
    table = embed @ layer
    known = np.bincount(np.concatenate([at for at, _, _ in used]), minlength=BUCKETS) > 0
    table[~known] = 0
    raw = np.array([weight @ table[at] + bias for at, weight, _ in held])
    truth = np.array([y for _, _, y in held])
    heats = np.geomspace(1, 20, 60)
    loss = [-np.mean(np.log(np.maximum(_softmax(raw / heat)[np.arange(len(truth)), truth], 1e-12))) for heat in heats]
    heat = float(heats[int(np.argmin(loss))])

    def least(values: np.ndarray, most: float) -> float:
        return min(most, float(np.quantile(values, reject_rate, method="lower")))

    chance = 1 / len(languages)
    threshold = least(_softmax(raw / heat).max(axis=1), chance + margin * (1 - chance)) if len(languages) > 1 else 0.0
    shares = np.array([weight[known[at]].sum() for at, weight, _ in held])
    return Model(languages, table.astype(np.float32), bias, heat, threshold, known, least(shares, float(known.mean() + np.median(shares)) / 2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_pylist()
            best, scores, rejected = [], [], []
            for has, buckets in zip(letters, subwords(batch.column(1)), strict=True):
                if has and model.languages:
                    p = _softmax(model.logits(buckets))
                    best.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                    rejected.append(scores[-1] < model.threshold or model.share_known(buckets) < model.least_known)
                else:
                    best.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id", of: int = 4) -> Column:
    """The fold of a row: crc32 of its id as text, modulo `of`; null ids have none."""
    return F.crc32(F.col(id_col).cast("string")) % of


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with all their columns, in one pass."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _predict(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            judged = next(judge(iter([pa.RecordBatch.from_arrays([text, text], names=["id", "text"])])))
            yield batch.filter(pc.invert(judged.column(3)))

    return docs.mapInArrow(run, fields)

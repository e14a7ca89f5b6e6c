import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackweave.llm import collocations as C

from .conftest_data import SF
from .helpers import documents, rng
from ..oracle import compare


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, best):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        longer = [q for (x, q), f in count.items() if x == lang and len(q) > len(p) and f >= least and f >= a and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if longer:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:best]))


def _rows(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def _texts(seed, n=120):
    r = rng(seed)
    vocabulary = ["the", "The", "of", "cat", "a", "a\x01", "a\x7f", "\x00", "é", "b|", "x", "日本"]
    return [("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(r.randint(0, 80))), r.choice(["en", "de", None, "a b", "A\x01", ""])) for _ in range(n)]


@pytest.mark.parametrize(("groups", "common"), [(1000, 3), (60, C.COMMON), (1, 0)])
def test_against_counting(spark, monkeypatch, groups, common):
    """With budgets that draw prefixes out to five words, to fewer, and not at all; with all words in codes, a few, and none."""
    monkeypatch.setattr(C, "COMMON", common)
    rows = _texts(groups) + [("go go go go go go go go " * 20, "en"), (None, "en"), ("", None), ("...", "de"), ("one", "xx")]
    docs = documents(spark, [(t, lang, "s") for t, lang in rows])
    assert _rows(C.collocations(docs, least=4, best=25, groups=groups)) == brute(rows, 4, 25)


def test_edges_of_batches(spark):
    """Nodes that are cut by small batches are added up."""
    rows = _texts(9, 60)
    docs = documents(spark, [(t, lang, "s") for t, lang in rows])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, C.BATCH_ROWS = C.BATCH_ROWS, 7
    try:
        assert _rows(C.collocations(docs, least=3, best=None)) == brute(rows, 3, 10**9)
    finally:
        C.BATCH_ROWS = held
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 10**14
    row = spark.createDataFrame([(3 * big - 1, big, 7 * big - 3, 5 * big + 7)], "a long, l long, r long, n long").select(C.exact_score())
    assert row.first()[0] == 1000 * (3 * big - 1) * (5 * big + 7) // (big * (7 * big - 3))


def test_odd_tables(spark):
    docs = documents(spark, ["a b", "a b"])
    assert C.collocations(docs.limit(0), least=1).count() == 0
    odd = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.phrase, r.a, r.score) for r in C.collocations(odd, least=2).collect()] == [("a b", 4, 2000)]


def test_sql(spark):
    from trackweave.llm import queries

    compare(spark, queries.QUERIES["op11_collocations"], queries.ORACLES["op11_collocations"], SF)


def test_equal_suffixes_are_told_from_equal_hashes():
    """With hashes that all clash, suffixes are still told apart."""
    import numpy as np

    data = np.frombuffer(b"a b a b c a b", dtype=np.uint8)
    own = C.Suffixes(["en"], data, np.array([0, len(data)]))
    places, size = np.arange(7), np.minimum(own.left, C.DEPTH)
    want = C._distinct(own, places, size)
    own.prefix_hashes = lambda depth: np.zeros(7, np.uint64)
    got = C._distinct(own, places, size)
    assert sorted(want[1]) == sorted(got[1]) == [1] * 7 and sorted(want[0]) == sorted(got[0])


def test_texts_are_read_twice(spark):
    """One pass counts, another hands suffixes on, also where buckets are drawn out to all words."""
    rows = [(t, lang) for t, lang in _texts(5, 60) if t]
    docs, read = documents(spark, [(t, lang, "s") for t, lang in rows]).select("lang", "text"), spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    C.phrase_counts(docs.mapInArrow(noted, docs.schema), least=4, groups=1000)
    assert read.value == 2 * len(rows)


@pytest.mark.parametrize("most", [1, 30])
def test_groups_of_bounded_size(spark, monkeypatch, most):
    """One group is asked for, but none may have more suffixes than the bound."""
    monkeypatch.setattr(C, "MOST", most)
    rows = _texts(most, 80) + [("go go go go go go go go " * 20, "en"), ("go go", "de"), ("a\tlong-tail of words", None)]
    docs = documents(spark, [(t, lang, "s") for t, lang in rows])
    assert _rows(C.collocations(docs, least=3, best=None, groups=1)) == brute(rows, 3, 10**9)


def test_equal_suffixes_do_not_fill_a_group(monkeypatch):
    """A phrase over the budget is a suffix a block, and all suffixes of a block and group are one row."""
    import pyarrow as pa

    monkeypatch.setattr(C, "BLOCK_BYTES", 1000)
    texts = ["go " * 400] * 20 + ["one two three four five six. seven eight"] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    counted = pa.Table.from_batches(C._count_words([batch])).to_pylist()
    loads = C.np.zeros(C.BUCKETS, dtype=C.np.int64)
    for row in counted:
        if row["lang"] is None:
            loads[row["hash"]] += row["n"]
    partition = C.Partition(loads, 100)

    class Shared:
        value = (partition, (C.np.zeros(0, C.np.uint64), pa.array([], pa.large_string())))

    emitted = [row for out in C._emit_suffixes(Shared)([batch]) for row in out.to_pylist()]
    n = [C.np.frombuffer(row["n"], C.np.int32) for row in emitted]
    assert sum(x.sum() for x in n) == loads.sum() == 20 * 399 + 2 * 6
    assert len(emitted) <= 21 * 5 and max(map(len, n)) <= 12
    by_group = {}
    for row, x in zip(emitted, n, strict=True):
        by_group[row["group"]] = by_group.get(row["group"], 0) + len(x)
    assert max(by_group.values()) <= 100

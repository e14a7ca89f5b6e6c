import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import decontaminate as D

from .helpers import documents, rng, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w = split(text)
    hit, found = set(), set()
    for item, phrase in items:
        p = split(phrase)
        size = min(window, len(p))
        for i in range(len(p) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == p[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_spans(spark, block_words):
    r = rng(2)
    items = [(i, words(r, r.randint(12, 40), 60)) for i in range(12)] + [(50, "Short one"), (51, ""), (52, None), (53, "..!"), (54, "é"), (12, words(r, 15)), (3, words(r, 20))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [words(r, 80, 60) for _ in range(20)] + [None, "", "...", "a short ONE here", "naïve é.", "é"]
    for _ in range(30):
        own = items[r.randrange(12)][1].split(" ")
        a = r.randint(0, 5)
        texts.append(words(r, r.randint(0, 30), 60) + " " + ("; " if r.random() < 0.3 else " ").join(own[a : a + r.randint(6, 30)]).upper() + "\n" + words(r, 5, 60))
    texts += [texts[-1], " ".join(items[0][1] for _ in range(4000)), items[1][1]]
    got = {x.doc_id: x for x in D.find_contamination(documents(spark, texts), benchmark, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 100_000:
            n, hit, found = brute(t, items)
            assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (n, hit, found), t
        raw = (t or "").encode()
        covered = [raw[s.start : s.end].decode() for s in got[i].spans]
        assert sum(len(split(x)) for x in covered) == got[i].n_hit and got[i].contaminated == bool(covered)


@pytest.mark.parametrize("block_words", [10**6, 6, 1])
def test_blocks_change_nothing(spark, block_words):
    """Repeated rows, null ids and texts of one length stay rows of their own, whatever the blocks."""
    items = [(1, "one two three"), (2, "three four five"), (2, "six"), (None, "seven eight"), (3, "five six")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x one two three four five six"), (1, "x one two three four five six"), (1, "a b c d e f g"), (None, "seven eight"), (None, "seven eight"), (None, "b c"), (None, None), (5, None)]
    got = D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, block_words=block_words).collect()
    seen = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), [(x.word, x.words) for x in r.spans]) for r in got)
    hit = ("1", 7, 6, ["1", "2", "3"], [(1, 6)])
    assert seen == sorted([hit, hit, ("1", 7, 0, [], []), ("None", 2, 2, [""], [(0, 2)]), ("None", 2, 2, [""], [(0, 2)]), ("None", 2, 0, [], []), ("None", 0, 0, [], []), ("5", 0, 0, [], [])])


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in D.find_contamination(documents(spark, ["a b"]), none).collect()] == [(2, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.find_contamination(documents(spark, ["a"]).limit(0), some).count() == 0
    kept = D.drop_contaminated(documents(spark, ["x a b", "a c b", None]), some)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and len(kept.columns) == 8


def test_query_digest(spark, tmp_path):
    from trackweave.llm.queries import op6_decontaminate

    documents(spark, ["a b c", "z"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "a b"), (9, "b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_items, r.items_sha256) for r in op6_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {0: (2, hashlib.sha256(b"10,9").hexdigest()), 1: (0, hashlib.sha256(b"").hexdigest())}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=5))
def test_fm_index(stretches, phrases):
    text = [0]
    for s in stretches:
        text += [*s, 0]
    index = D.FMIndex(np.array(text), 5, sample=4)
    phrases = np.array(phrases)
    low, high = index.intervals(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == list(p)]
        assert sorted(index.locate(np.arange(a, b))) == want if a < b else not want


def test_blocks_share_one_pass(spark):
    """Sixty blocks are one map step over the documents, and take at most twice the time of one."""
    import time

    r = rng(5)
    benchmark = spark.createDataFrame([(i, words(r, 30, 400)) for i in range(60)], "item_id long, text string")
    docs = documents(spark, [words(r, 200, 400) for _ in range(60)] + [benchmark.first().text])
    took = {}
    for block_words in (10**6, 10**6, 1):
        found = D.find_contamination(docs, benchmark, block_words=block_words)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        begin = time.monotonic()
        assert [x.doc_id for x in found.filter("contaminated").collect()][-1] == 60
        took[block_words] = time.monotonic() - begin
    assert took[1] < 2 * took[10**6] + 1

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import token_alignment as T

from .helpers import documents, rng, words

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

TEXTS = [
    None, "", " ", "  ", "\n", "a", "The quick brown fox", "two  spaces   three", " leading", "trailing ", "tab\there\nline \n x", "it's 'll we've",
    "café naïve über", "日本語 text", "a▁b has the mark", "▁", "<|endoftext|> inside <s> </s> <unk> <0x0A>", "\U0001f600 smile \U0001f600\U0001f600", "nbsp here  x  y", "\x00 nul \x01", "12345 67,89.0",
    "word " * 3000, "aaaa" * 500, "ﬁ ligature", "é combining", "　 wide", " 　x  y  z",
]


def brute(texts):
    """Whole texts, one after another, byte by byte."""
    a_side, b_side = T._sides(A_FILE, B_FILE)
    model = Tokenizer.from_file(A_FILE)
    model.encode_special_tokens = True
    byte = lambda side, i: side.data[side.begin[i] : side.begin[i + 1]].tobytes()
    rows, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.model.encode(text) if text else []
        if b"".join(byte(a_side, i) for i in a) != want or b"".join(byte(b_side, i) for i in b) != want:
            a, b = [], []
        ends = [[], []]
        for side, ids, out in ((a_side, a, ends[0]), (b_side, b, ends[1])):
            at = 0
            for i in ids:
                at += len(byte(side, i))
                out.append(at)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in shared] if len(want) < 20_000 else []
        groups, low = [], 0
        for e in shared:
            groups.append(",".join(str(i) for i, x in zip(a, ends[0]) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, ends[1]) if low < x <= e))
            low = e
        spans = [[(x - len(byte(s, i)), x) for i, x in zip(ids, out)] for s, ids, out in ((a_side, a, ends[0]), (b_side, b, ends[1]))]
        over = sum(x < v and u < y for x, y in spans[0] for u, v in spans[1]) if len(want) < 5000 else None
        rows.append([len(a), len(b), len(groups), len(links), over, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
        counts.update(links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(r[0], r[1], r[2], r[3], sum(counts[p] == most[p[1]] for p in r[5]), sum(counts[p] for p in r[5]), r[6]) for r in rows], [r[4] for r in rows]


def _check(spark, texts):
    want, over = brute(texts)
    got = sorted(T.align(documents(spark, texts), A_FILE, B_FILE).collect(), key=lambda r: r.doc_id)
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got] == want
    assert all(x is None or x == r.n_overlaps for x, r in zip(over, got))
    return got


def test_awkward_texts(spark):
    got = _check(spark, TEXTS + TEXTS[5:8])
    assert got[14].n_a == got[15].n_a == 0 and got[14].groups_sha256 == "" and got[6].n_links > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    r = rng(seed)
    marks = [" ", "  ", "\n", ".", ",", "'s", "é", " ", "\t", "-", "7", "ab", "the", " Of", "日"]
    _check(spark, ["".join(r.choice(marks) for _ in range(r.randint(1, 60))) for _ in range(150)] + [words(r, 80) for _ in range(20)])


def test_rare_pairs_are_joined(spark, monkeypatch):
    """With hardly any pair sent to the tasks, the results are the same."""
    texts = TEXTS[5:21] * 3
    want, _ = brute(texts)
    monkeypatch.setattr(T, "MOST_PAIRS", 2)
    got = sorted(T.align(documents(spark, texts), A_FILE, B_FILE).collect(), key=lambda r: r.doc_id)
    assert [(r.n_best, r.count_sum) for r in got] == [(x[4], x[5]) for x in want]


def test_odd_tables(spark):
    docs = documents(spark, ["the cat", "the cat"])
    assert T.align(docs.limit(0), A_FILE, B_FILE).count() == 0
    odd = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    rows = T.align(odd, A_FILE, B_FILE).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None", "None"] and {r.count_sum for r in rows} == {8}

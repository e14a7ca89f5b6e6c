from trackweave.llm import near_dedup
from trackweave.llm.components import connected_components

from .helpers import documents, edited, rng, words


def shingles(text, k):
    w = [x.decode() for x in bytes((text or "").encode()).lower().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k, per_cent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= per_cent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def _check(spark, texts, k):
    roots, sizes = brute(texts, k, 80)
    got = {r.doc_id: r for r in near_dedup.near_dedup(documents(spark, texts), k=k).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_groups(spark):
    """A large family around the threshold, small families, copies and awkward texts."""
    r = rng(4)
    base, other = words(r, 120), words(r, 40)
    texts = [edited(r, base, r.choice([0.01, 0.03, 0.05, 0.08, 0.12])) for _ in range(120)]
    texts += [edited(r, other, 0.04) for _ in range(8)] + [words(r, 60) for _ in range(30)]
    texts += [None, "", " \n", "A", "a", "a b", "A\tB", "B a", "é", "É", texts[0], texts[0], base.upper(), "w1 " * 5000]
    r.shuffle(texts)
    _check(spark, texts, 2)


def test_five_words(spark):
    r = rng(5)
    base = words(r, 200)
    _check(spark, [edited(r, base, r.choice([0.01, 0.02, 0.03])) for _ in range(40)] + ["a b c", "a b c", "A b c d", None], 5)


def test_odd_tables(spark):
    docs = documents(spark, ["a b c d", "a b c d"]).select("doc_id", "text")
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
    odd = docs.union(docs).union(spark.createDataFrame([(None, "a b c d")], docs.schema))
    rows = near_dedup.near_dedup(odd).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in rows) == [(-1, None, False), (0, 0, True), (0, 0, True), (1, 0, False), (1, 0, False)]
    assert near_dedup.drop_near_copies(docs).count() == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == 0 and got[202] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

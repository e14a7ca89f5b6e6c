import pytest

from trackweave.llm import ngram_join as N
from trackweave.llm import queries

from ..oracle import compare
from .conftest_data import SF
from .helpers import documents, edited, rng, words
from .test_near_dedup import brute


def _check(spark, texts, k=4, per_cent=85):
    roots, sizes = brute(texts, k, per_cent)
    got = {r.doc_id: r for r in N.ngram_join(documents(spark, texts), k=k, per_cent=per_cent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


@pytest.mark.parametrize(("narrow", "tile"), [(64, 512), (1000, 512), (2, 3)])
def test_groups(spark, monkeypatch, narrow, tile):
    """A large family around the threshold, small families, copies, shared passages and awkward texts; columns whole, in one and in many tiles."""
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "NARROW", narrow)
    r = rng(14)
    base, other, passage = words(r, 160), words(r, 60), words(r, 30)
    texts = [edited(r, base, r.choice([0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(110)]
    texts += [edited(r, other, 0.02) for _ in range(10)] + [words(r, r.randint(20, 60)) + " " + passage for _ in range(30)]
    texts += [None, "", " \n", "A", "a", "a b", "A\tB", "B a", "a b c", "a b c d", "A B C D", "é", texts[0], texts[0], base.upper(), "w1 " * 3000]
    r.shuffle(texts)
    _check(spark, texts)


def test_a_chain_in_pieces(spark):
    """Neighbours link, others do not; lengths drift over several size bands."""
    w = [f"x{i}" for i in range(400)]
    _check(spark, [" ".join(w[i * 4 : 120 + i * 5]) for i in range(40)])
    _check(spark, [" ".join(w[: 40 + 6 * i]) for i in range(50)], k=2, per_cent=90)


def test_odd_tables(spark):
    docs = documents(spark, ["a b c d e", "a b c d e"]).select("doc_id", "text")
    assert N.ngram_join(docs.limit(0)).count() == 0
    odd = docs.union(docs).union(spark.createDataFrame([(None, "a b c d e")], docs.schema))
    rows = N.ngram_join(odd).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in rows) == [(-1, 2, None), (0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0)]


def test_ids_may_be_texts(spark):
    docs = documents(spark, ["a b c d e f g h"] * 2 + ["q"]).selectExpr("concat('d', doc_id) as doc_id", "text")
    assert sorted((r.doc_id, r.component_id) for r in N.ngram_join(docs).collect()) == [("d0", "d0"), ("d1", "d0"), ("d2", "d2")]


def test_sql(spark):
    compare(spark, queries.QUERIES["op12_ngram_join"], queries.ORACLES["op12_ngram_join"], SF)

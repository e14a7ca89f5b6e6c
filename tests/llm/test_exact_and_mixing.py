import hashlib
from collections import defaultdict

import duckdb
import pytest

from trackweave.llm import exact_dedup, mixing

from .helpers import documents, words, rng

TEXTS = ["a", None, "", "a", "b", "A", "a ", "é", "é", "x" * 300_000, "x" * 300_000, "c"]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    docs = documents(spark, TEXTS)
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        own = groups[t or ""]
        chosen = (min if keep == "min" else max)(own)
        assert tuple(got[i]) == (i, chosen, len(own), chosen == i, hashlib.sha256((t or "").encode()).hexdigest())
    kept = {r.doc_id: r for r in exact_dedup.drop_copies(docs, keep=keep).collect()}
    assert sorted(kept) == sorted(i for i, r in got.items() if r.kept)
    assert all(r.text == TEXTS[i] and r.id == "x" and r.keep_id == -1 for i, r in kept.items())


def test_exact_odd_rows(spark):
    docs = documents(spark, ["a", "a"]).selectExpr("doc_id", "text", "lang")
    odd = docs.union(docs).union(spark.createDataFrame([(None, "a", None), (None, "q", None)], docs.schema))
    rows = exact_dedup.exact_dedup(odd).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 1, True), (-1, 0, 5, False), (0, 0, 5, True), (0, 0, 5, True), (1, 0, 5, False), (1, 0, 5, False)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in exact_dedup.drop_copies(odd).collect()) == [(-1, "q"), (0, "a")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_exact_plan(spark):
    """Copies are combined before the shuffle, and nothing runs in Python."""
    plan = exact_dedup.exact_dedup(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Python" not in plan and "Arrow" not in plan


def _sizes():
    r = rng(1)
    return [(words(r, int(r.paretovariate(0.7)) % 900), "en", r.choice(["a", "a", "a", "b", None, "é", "zz"])) for _ in range(400)] + [(None, "en", "empty"), ("", "en", "a"), ("one", "en", "tiny")]


def test_mix(spark):
    docs = documents(spark, _sizes())
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 403 and all(0 <= r.taken <= 2 * r.size for r in rows)
    total, taken = sum(r.size for r in rows), defaultdict(int)
    target, size = {r.source: r.target for r in rows}, {r.source: r.source_size for r in rows}
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and all(target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    order = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [target[s] / weight[s] for s in target if target[s] < 2 * size[s]]
    assert max(free) - min(free) < 1e-6 * max(free)
    assert all(target[s] / weight[s] <= free[0] + 1e-6 for s in target)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    cut = [r for r in rows if 0 < r.part < r.size]
    assert len(cut) <= len(target)


def test_mix_oracle(spark):
    docs = documents(spark, _sizes())
    frame = docs.select("doc_id", "text", "source").toPandas()
    db = duckdb.connect()
    db.sql("create view documents as select * from frame")
    want = {r[0]: r[1:] for r in db.sql(mixing.ORACLE).fetchall()}
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()}
    assert got == want


def test_mix_empty(spark):
    docs = documents(spark, [None, ""])
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix_sources(docs).collect()) == [(0, 0.0, 0), (1, 0.0, 0)]
    assert mixing.mix_sources(docs.limit(0)).count() == 0

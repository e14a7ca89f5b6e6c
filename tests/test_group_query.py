import itertools

import pytest

from trackweave.operators import group_query as G
from trackweave.schema import LOG_RECORD


def rows():
    records = {
        1: [("VCL_Log", "track a"), ("Timestamp", "Resp: 10.5 0.2 0.1")],
        2: [("VCL_Log", "other"), ("vcl_log", None)],
        3: [("Timestamp", "resp:   7 0.9"), ("Timestamp", "Start: 1.0")],
        4: [("VCL_Log", "track key x"), ("Timestamp", "Resp: none")],
    }
    out = [(g, g, None, "req", "c", 0, i, tag, p, None) for g, own in records.items() for i, (tag, p) in enumerate(own)]
    return out + [(None, 9, None, "req", "c", 0, 0, "VCL_Log", "track lost", None)]


def groups(frame):
    return sorted({r.group_vxid for r in frame.collect()})


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (G.record("vcl_LOG", "~", "^track "), [1, 4]),
        (G.record("VCL_Log"), [1, 2, 4]),
        (G.record("VCL_Log", "!~", "^track"), [2]),
        (G.record("VCL_Log", "ne", "other"), [1, 4]),
        (G.record("Timestamp", ">=", 10.5, prefix="Resp", field=1), [1]),
        (G.record("Timestamp", "<", 8, prefix="Resp", field=1), [3]),
        (G.record("Timestamp", "==", 0.2, prefix="resp", field=2) | G.record("Timestamp", ">", 0.5, prefix="Resp", field=2), [1, 3]),
        (G.record("Timestamp", prefix="Resp", field=2), [1, 3]),
        (~G.record("Timestamp", prefix="Resp"), [2]),
        (~(G.record("VCL_Log", "~", "key") | G.record("VCL_Log", "eq", "other")) & ~G.record("VSL"), [1, 3]),
        (G.record("VCL_Log", side="b"), []),
    ],
)
def test_conditions(spark, query, want):
    log = spark.createDataFrame(rows(), LOG_RECORD)
    assert groups(G.filter_groups(log, query)) == want
    assert sorted(r.group_vxid for r in G.match_groups(log, {"q": query}).collect() if r.q) == want


def test_combinations_against_plain_logic(spark):
    """All and/or/not trees of three conditions over two levels, in one grouping."""
    log = spark.createDataFrame(rows(), LOG_RECORD)
    parts = [G.record("VCL_Log", "~", "^track "), G.record("Timestamp", prefix="Resp"), G.record("VCL_Log", "eq", "other")]
    truth = {g: [g in (1, 4), g in (1, 3, 4), g == 2] for g in (1, 2, 3, 4)}
    queries, want = {}, {}
    for (i, j, k), (inner, outer, flip) in itertools.product(itertools.permutations(range(3)), itertools.product("&|", "&|", [False, True])):
        name = f"q{len(queries)}"
        q = parts[i] & parts[j] if inner == "&" else parts[i] | parts[j]
        q = ~q if flip else q
        queries[name] = q & parts[k] if outer == "&" else q | parts[k]
        for g, t in truth.items():
            x = (t[i] and t[j]) if inner == "&" else (t[i] or t[j])
            x = x != flip
            want[g, name] = (x and t[k]) if outer == "&" else (x or t[k])
    for r in G.match_groups(log, queries).collect():
        assert {n: r[n] for n in queries} == {n: want[r.group_vxid, n] for n in queries}


def test_one_exchange_and_empty_table(spark):
    log = spark.createDataFrame(rows(), LOG_RECORD)
    q = G.record("VCL_Log", "~", "^track ") & ~G.record("Timestamp", prefix="Resp") | G.record("VSL")
    for frame in (G.filter_groups(log, q), G.match_groups(log, {"q": q})):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(group_vxid") == 1 and "Join" not in plan
        assert frame.limit(0).count() == 0
    assert G.match_groups(log.limit(0), {"q": q}).count() == 0
    with pytest.raises(ValueError):
        G.record("VCL_Log", "=~", "x")

import duckdb
import pytest

import corpus_pipeline
from trackweave.llm import queries

from .. import oracle
from .conftest_data import SF
from .helpers import documents, edited, rng, words
from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as near


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_stages(spark, tmp_path):
    """Every stage against brute force on what its predecessor kept."""
    r = rng(9)
    texts = [words(r, 80, 2000) for _ in range(40)]
    items = [(i, words(r, 20, 2000)) for i in range(4)]
    texts += [texts[0], texts[1], texts[1]] + [edited(r, texts[2], 0.02) for _ in range(5)] + [f"{texts[4]} {items[1][1]}", None, "", "12 34"]
    docs = documents(spark, [(t, "en", f"s{i % 4}") for i, t in enumerate(texts)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before = {x.doc_id: x.text for x in kept.collect()}
        out = stage(spark, kept, str(tmp_path))
        after = sorted(x.doc_id for x in out.collect())
        ids = sorted(before)
        if name == "language id":
            want = [i for i in ids if any(c.isalpha() for c in before[i] or "")]
        elif name == "exact dedup":
            want = sorted({before[i]: i for i in reversed(ids)}.values())
        elif name == "near dedup":
            roots, _ = near([before[i] for i in ids], 5, 80)
            want = [i for k, i in enumerate(ids) if roots[k] == k]
        elif name == "decontamination":
            want = [i for i in ids if not leaks(before[i], items)[1]]
        else:
            want = ids
        assert after == want, name
        if name != "mixing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            kept = spark.read.parquet(str(tmp_path / name))
    assert names == ["language id", "exact dedup", "near dedup", "decontamination", "mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
    kept.toPandas().to_parquet(tmp_path / "kept.parquet")
    from trackweave.llm import mixing

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/kept.parquet'")
    assert {x[0]: x[4] for x in db.sql(mixing.ORACLE).fetchall()} == {x.doc_id: x.taken for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

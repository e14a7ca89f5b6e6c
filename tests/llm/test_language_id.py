import random
import zlib

import pytest

from trackweave.llm import language_id as L

from .conftest_data import SF
from .helpers import rng


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.filter(L.fold() != 2))
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "жщ ыъ эюя фцч"), (5, "The and of " * 60_000), (5, "é")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in L.predict(odd, model).collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)] and got[3][2] and got[4] == (5, "en", False) and len(got) == 6
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in rows)


def test_counts_are_of_whole_texts():
    import pyarrow as pa

    one, many, none = L.subwords(pa.array(["ab cd", "ab cd " * 300_000, None]))
    assert len(one) == 14 and len(many) == 300_000 * len(one) and set(many.tolist()) == set(one.tolist()) and len(none) == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert [(r.lang_pred, r.score) for r in L.predict(docs, model).collect()] == [("und", 0.0)]
    assert L.predict(docs.limit(0), model).count() == 0


SYLLABLES = {"aa": "ka mo ti ru se no la".split(), "bb": "zur pfe gno sch drü wix".split(), "cc": "água ção nhe lho rês".split(), "dd": "yth wyn llo ddu ffa ngh".split()}


def _text(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], ["aa", "bb", "cc", "dd"]])
def test_rejection_with_any_number_of_languages(spark, langs):
    """Texts of other scripts and of letters at random are rejected, clean texts of one word or many are not."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, _text(langs[i % len(langs)], r.randint(1, 60), r), langs[i % len(langs)]) for i in range(400)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    clean = [(i, _text(langs[i % len(langs)], r.randint(3, 80), r)) for i in range(200)]
    foreign = [(1000 + i, " ".join("".join(r.choice("жщыъэюяфцчбдгкл") for _ in range(r.randint(2, 9))) for _ in range(20))) for i in range(50)]
    foreign += [(2000 + i, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20))) for i in range(50)]
    got = {x.doc_id: x for x in L.predict(spark.createDataFrame(clean + foreign, "doc_id long, text string"), model).collect()}
    assert sum(got[i].rejected for i, _ in clean) == 0
    assert all(got[i].lang_pred == langs[i % len(langs)] for i, _ in clean)
    assert sum(got[i].rejected for i, _ in foreign) >= 95


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "ka mo", "aa", "x", 0.5), (1, "ka mo", "aa", "x", 0.5), (None, "ka", "aa", None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score double")
    got = L.predict(docs, L.fit(docs)).collect()
    assert len(got) == 4 and sorted(r.lang_pred for r in got) == ["aa", "aa", "aa", "und"]


def test_sample_is_bounded_and_repeatable(spark):
    """Rows without ids are learned from, rows of one id do not flood the sample, texts are learned from whole, and reruns agree."""
    import numpy as np

    r = rng(4)

    def text(letters, n):
        return " ".join("".join(r.choices(letters, k=5)) for _ in range(n))

    rows = [(None, text("abcdef", 30), "aa") for _ in range(400)] + [(i, text("uvwxyz", 3000), "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [L.fit(docs.repartition(n), per_language=20, epochs=1) for n in (2, 5)]
    assert np.array_equal(models[0].table, models[1].table) and models[0].languages == ["aa", "bb"]
    small = L.fit(docs, per_language=20, sample_bytes=1, epochs=1)
    assert all(m.known.sum() > 50 for m in models)
    assert small.known.sum() < models[0].known.sum()

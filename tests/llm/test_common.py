import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackweave.llm import text_arrays as A
from trackweave.llm.common import join_counted, materialize, number_rows


def test_numbers(spark):
    names = spark.createDataFrame([(x,) for x in ["b", "é", "a", None, "Z", "aa", "zz", "𝄞"]], "name string")
    got = [r.name for r in number_rows(names, [F.col("name").asc_nulls_last()], "n").orderBy("n").collect()]
    assert got == ["Z", "a", "aa", "b", "zz", "é", "𝄞", None]
    assert sorted(r.n for r in number_rows(spark.range(1000), [F.col("id").desc()], "n").collect()) == list(range(1000))


def test_materialize_keeps_settings(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert materialize(spark.range(3), "x").count() == 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_join_counted(spark):
    """A key of half of all rows, keys of one row, keys without a partner and repeated rows, as a plain join gives them."""
    rows = spark.range(6000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("k"), (F.col("id") % 100).alias("x"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most")).where("k % 3 = 0")
    got = join_counted(rows, keyed, ["k"], rows.count())
    assert got.columns == ["k", "x", "most"] and got.count() > 3000
    assert sorted(got.collect()) == sorted(rows.join(keyed.drop("n"), "k").collect())
    assert join_counted(rows.limit(0), keyed.limit(0), ["k"], 0).count() == 0


def test_words_and_hashes():
    texts = ["a bb\tA", None, "", " x ", "bb", "é-é", "a" * 3_000_000 + " bb"]
    data, offsets = A.utf8(pa.array(texts))
    seen = []
    for first, last in A.blocks(offsets):
        part, at = A.LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        starts, ends, words = A.word_bounds(part, at, A.NOT_SPACE)
        hashes = A.word_hashes(part, starts, ends)
        seen += [hashes[words[i] : words[i + 1]].tolist() for i in range(last - first)]
    assert [len(x) for x in seen] == [3, 0, 0, 1, 1, 1, 2]
    assert seen[0][0] == seen[0][2] and seen[0][1] == seen[4][0] == seen[6][1] and len({h for x in seen for h in x}) == 5


def test_shingles():
    words = np.array([1, 2, 3, 9, 1, 2], np.uint64)
    hashes, at = A.shingle_hashes(words, np.array([0, 3, 3, 4, 6]), 2)
    assert at.tolist() == [0, 2, 2, 3, 4] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3

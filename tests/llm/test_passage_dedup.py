import hashlib

from pyspark.sql import functions as F

from trackweave.llm import passage_dedup as X
from trackweave.llm.queries import op7_line_dedup

from ..conftest import SF
from .helpers import documents, rng, words


def brute(texts, least):
    """The words of each text in a run of `least` words that occurred in an earlier text, or ended before in the same one."""
    first, gone = {}, []
    for i, text in enumerate(texts):
        own, lost = (text or "").split(), set()
        for s in range(len(own) - least + 1):
            at = first.setdefault(tuple(own[s : s + least]), (i, s))
            if at[0] < i or at[1] + least <= s:
                lost.update(range(s, s + least))
        gone.append(lost)
    return gone


def test_a_run_that_overlaps_itself_stays_once(spark):
    line = " ".join(f"w{i}" for i in range(25)) + "\n"
    texts = [line * 4, "la " * 130, line * 3 + "end", "x " + line * 2]
    got = {x.doc_id: x for x in X.drop_repeated_passages(documents(spark, texts)).collect()}
    assert [got[i].words_removed for i in range(4)] == [len(x) for x in brute(texts, 50)] == [50, 80, 75, 50]
    assert got[0].text.split() == (line * 2).split() and got[1].text.split() == ["la"] * 50


def test_against_brute_force(spark):
    r = rng(7)
    passages = [words(r, r.randint(3, 40)).split() for _ in range(12)] + [["x"] * 30, ["é", "ü"] * 9]
    texts = []
    for _ in range(80):
        text = ""
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            for w in r.choice([p, p[a:], p[:a], words(r, r.randint(0, 8)).split()]):
                text += w + r.choice([" ", " ", " ", "\n", "\n\n", " ", " ", "\t"])
        texts.append(text)
    texts += [None, "", " \n", "same words of a line " * 30, texts[3], "a b " * 40, "b a b b " * 20 + "a b " * 9]
    for least in (1, 8, 15):
        want = brute(texts, least)
        got = {x.doc_id: x for x in X.drop_repeated_passages(documents(spark, texts), min_words=least).collect()}
        assert len(got) == len(texts)
        assert any(want)
        for i, text in enumerate(texts):
            assert got[i].words_removed == len(want[i])
            assert got[i].n_lines == sum(1 for x in (text or "").split("\n") if x.split())
            assert (got[i].text is None) == (text is None)
            assert (got[i].text or "").split() == [w for j, w in enumerate((text or "").split()) if j not in want[i]]
            if not want[i]:
                assert got[i].text == text


def test_cut_inside_lines(spark):
    passage = [f"p{i}" for i in range(60)]
    flat, broken = " ".join(passage), " ".join(passage[:25]) + "\n" + " ".join(passage[25:])
    texts = [f"one {flat} two", f"three\nfour {broken} five\nsix", f"seven\n\n{flat}\n\neight", f"{flat} nine", f"ten {flat}\neleven", flat, " ".join(passage[:49])]
    got = {x.doc_id: x for x in X.drop_repeated_passages(documents(spark, texts)).collect()}
    assert [got[i].text for i in range(7)] == [texts[0], "three\nfour five\nsix", "seven\n\neight", "nine", "ten\neleven", "", texts[6]]
    assert [got[i].words_removed for i in range(7)] == [0, 60, 60, 60, 60, 60, 0]
    assert [got[i].n_removed for i in range(7)] == [0, 0, 1, 0, 0, 1, 0]


def test_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [f"a {passage} b", f"c {passage} d", f"{passage} e"])
    docs = docs.union(docs.where("doc_id = 1")).selectExpr("if(doc_id = 2, null, doc_id) as doc_id", "text")
    got = sorted((x.doc_id is None, x.doc_id, x.text) for x in X.drop_repeated_passages(docs).collect())
    assert got == [(False, 0, f"a {passage} b"), (False, 1, "c d"), (False, 1, "c d"), (True, None, f"{passage} e")]
    assert X.drop_repeated_passages(docs.limit(0)).count() == 0


def test_query_finds_passages_inside_lines(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    documents(spark, [f"a {passage} b", f"c {passage} d"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [(x.doc_id, x.words_removed) for x in op7_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, 0), (1, 60)]


def test_digest_of_words(spark):
    """White space of every kind parts words; the digest is made where the texts are, not by a pattern over each of them."""
    spaces = [chr(c) for c in range(0x3100) if not chr(c).split()]
    docs = documents(spark, ["".join(f"{s}a{s}ü" for s in spaces), " ".join(["a ü"] * len(spaces)), None, " \n"])
    found = X.digest(docs.select("doc_id", "text"))
    got = {x.doc_id: x.words_sha256 for x in found.collect()}
    assert got[0] == got[1] == hashlib.sha256(" ".join(["a ü"] * len(spaces)).encode()).hexdigest() and got[2] == got[3] == hashlib.sha256(b"").hexdigest()
    assert {x.sha for x in docs.where("doc_id < 2").select(F.sha2(F.trim(F.regexp_replace("text", f"[{X.SPACE}]+", " ")), 256).alias("sha")).collect()} == {got[0]}
    assert "regexp_replace" not in op7_line_dedup(spark, SF)._jdf.queryExecution().toString()

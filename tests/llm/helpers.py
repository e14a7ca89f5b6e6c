"""Small documents with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, id string, taken string"


def documents(spark, texts, lang="en", source="s", first=0):
    """A documents table with extra columns whose names clash with results; texts may be (text, lang, source)."""
    rows = []
    for i, t in enumerate(texts):
        text, own_lang, own_source = t if isinstance(t, tuple) else (t, lang, source)
        rows.append((first + i, text, own_lang, own_source, len(text or ""), -1, "x", None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split(" "))


def rng(seed=0):
    return random.Random(seed)

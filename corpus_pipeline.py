"""A corpus pipeline of five stages, each one of the operators in trackweave.llm.

Every stage takes what its predecessor kept and returns the columns of `documents`; the last adds how
often each document is taken. Near duplicates are judged on five-word shingles at a similarity of
0.8, and of a group the document with the smallest id stays, as with exact copies. A document that
holds a test phrase is dropped whole. No SQL states the language model or the signatures, so there is
no ORACLE_SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from trackweave.llm.common import materialize, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a confident language; the model learns from the labelled rows."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of equal texts."""
    return exact_dedup.drop_copies(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of linked documents."""
    return near_dedup.drop_near_copies(docs, k=5, per_cent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a ten-word phrase of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document gives to the mix: words taken, whole repetitions, words of a partial one, and the source's target."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, html_text, language_id, licences, mixing, near_dedup, ngram_join, passage_dedup, secrets, token_alignment, warc
from .common import new_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=2, per_cent=80)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return passage_dedup.digest(found.select("doc_id", "n_lines", "n_removed", "words_removed", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"])))
    places = F.transform("found", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"]))
    return found.select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_licences"), F.array_join(names, ",").alias("licences"), F.array_join(places, ",").alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold() == 2, F.lit(False))
    model = language_id.fit(docs.filter(language_id.fold() != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, best=2000)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=4, per_cent=85)


#: The folder of the tokenizers' files, the same on every executor.
TOKENIZERS = "/opt/tokenizers"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_html_text": op5_html_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_licence_scan": op9_licence_scan,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_ngram_join": op12_ngram_join,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": passage_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_ngram_join": ngram_join.ORACLE,
}

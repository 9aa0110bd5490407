"""The corpus operators' queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import divergence, html_main, knn, langid, licenses, line_dedup, media, mixing, ngram_join, pieces, toxicity, trie, warc
from quern.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op3_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_five(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digest(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_beginnings(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_main_text, op3_voronoi_top_k, op4_line_dedup, op5_ngram_jaccard_join,
        op6_sentencepiece_nbest, op7_media_columns, op8_toxicity, op9_source_mixing, op10_language_id, op11_source_divergence,
        op12_warc_transactions, op13_conversation_trie,
    )
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.sql(), "op9_source_mixing": mixing.SQL, "op11_source_divergence": divergence.SQL, "op12_warc_transactions": warc.SQL, "op13_conversation_trie": trie.SQL,
}

"""The corpus pipeline: documents in a known language, without repeated lines and near copies, mixed to target weights, as piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's rows as Parquet to
the shared folder and gives them to the next one.  The stages have no common SQL,
so there is none for the whole; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, line_dedup, mixing, ngram_join, pieces
from quern.llm.common import materialise, short_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    short_batches(spark)
    return langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line, and documents of which nothing is left."""
    short_batches(spark)
    return line_dedup.keep_first_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    short_batches(spark)
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's budget asks for."""
    short_batches(spark)
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; returns doc_id, lang, source, ids, n_tokens, score, the second best segmentation and round_trip."""
    short_batches(spark)
    return pieces.tokenised(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("source mixing", source_mixing),
    ("SentencePiece encoding", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: each stage calls one operator and works on what the one before it kept.

The table between two stages is written as Parquet and read again. All stages but the last return the
columns of documents; a line that is dropped shortens text and n_chars. Rows that share a doc_id are
one document: they stay or go together. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language_id, line_dedup, ngram_join, packing, quality
from quern.llm.shared import Scratch

#: A document whose best language scores less is rejected. Noise and other scripts are und to language_id, as is a text without a letter.
MIN_LANGUAGE_SCORE = 0.3
#: Removed documents up to which their ids (8 bytes each) are broadcast; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 1 << 20


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    out = language_id.identify(docs, language_id.fit(docs), docs.columns)
    _, lang, score = out.columns[:3]
    return out.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs, model, docs.columns)
    return out.filter(F.col(out.columns[1]) >= (quality.THRESHOLD if model else 0)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    scratch = Scratch(spark, "pipeline_near")
    groups = ngram_join.jaccard_components(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = scratch.table(groups.filter("not stays").select("doc_id"), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", keep_languages), ("quality", keep_quality), ("line_dedup", drop_lines), ("ngram_join", drop_near_duplicates), ("packing", pack)]
#: Classifiers and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

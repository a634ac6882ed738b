"""A corpus clean-up pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chafe.llm import decontaminate, line_dedup, sentencepiece_unigram, simhash_dedup, toxicity
from chafe.llm.common import fresh, scratch, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from ``documents``
    and ``labels``, whatever an earlier stage kept."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, counts=tuple(fresh(docs, "__n_lines", "__n_dropped"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the least doc_id."""
    return simhash_dedup.keep_first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, text): piece ids, and the text decoded from them."""
    out = sentencepiece_unigram.round_trip(docs.select("doc_id", "text"), VOCABULARY)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

# The classifier, the fingerprints' links and the pieces have no SQL form; the
# tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

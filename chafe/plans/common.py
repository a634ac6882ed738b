"""Shared building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import assign_category, keyword_category, score_columns
from ..operators.prep import Funnel, build_review_items
from ..session import scratch_table
from ..sources.adapters import cleaned, pull_requests, review_comments, reviews, task_types
from ..sources.tables import load_table

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (results are compared across engines), except
    p-values, where the small ones are what matters."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name != "p_value":
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(load_table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def with_category(s: DataFrame) -> DataFrame:
    return s.withColumn("friction_category",
                        assign_category("is_negative", keyword_category("clean_body")))


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents -> clean -> length filter -> lexicon score -> category."""
    return with_category(score_columns(clean_documents(spark, d), "clean_body"))


def _items(spark: SparkSession, d: str, derive) -> DataFrame:
    """Review items whose texts were cleaned (and scored) once each, before the
    joins that repeat them."""
    docs = derive(cleaned(load_table(spark, d, "documents").select("doc_id", "text")))
    conv = derive(cleaned(load_table(spark, d, "conversations")))
    return build_review_items(pull_requests(spark, d), review_comments(spark, d, docs), reviews(spark, d, conv),
                              task_types(spark, d))


def digested(t: DataFrame) -> DataFrame:
    """A text's length and MD5 in its place: the joins repeat texts many times."""
    return t.withColumn("clean_len", F.length("clean_body")).withColumn("text_md5", F.md5("clean_body")).drop("clean_body")


def review_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, digested)


def scored_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, lambda t: with_category(score_columns(t, "clean_body")))


def counted_items(spark: SparkSession, d: str, texts_apart: bool = False) -> tuple[DataFrame, Funnel]:
    """Scored review items and the funnel that counts their steps on the way.
    Short texts stay up to the length step, so that it is counted behind the joins.

    With ``texts_apart`` the cleaned and scored texts are written once, in tables of
    their own, and items hold their ``text_md5`` instead of repeating them."""
    def derive(t: DataFrame) -> DataFrame:
        s = with_category(score_columns(cleaned(t, keep_short=True), "clean_body"))
        return digested(scratch_table(s)) if texts_apart else s
    docs = derive(load_table(spark, d, "documents").select("doc_id", "text"))
    conv = derive(load_table(spark, d, "conversations"))
    funnel = Funnel()
    items = build_review_items(pull_requests(spark, d), review_comments(spark, d, docs, keep_all=True),
                               reviews(spark, d, conv), task_types(spark, d), funnel=funnel)
    return items, funnel

"""Domain tables derived from the driver's parquet tables.

The reference reads four tables of pull requests, inline comments, reviews
and task types.  The driver ships TPC-H-style tables instead; these
functions derive the domain tables from them so every analysis runs over
whole tables and grows with them:

  pull requests  <- orders (+ last ship date of the order's lines as close time)
  task types     <- orders x customer market segment
  inline comments<- lineitem, body = text of document (part key modulo documents)
  reviews        <- conversations (one PR per conversation id)

URLs are built in the same shape as the hosting API's so key extraction and
the composite-key join do real work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, long_enough
from ..session import redistribute, where_here
from .tables import load_table

# ---- fixed values of the stand-in mapping -------------------------------------
API_ROOT = "https://api.github.com/repos/"
ORDER_STATE = {"F": "closed", "O": "open", "P": "merged"}
OWNERS, REPOS = 53, 11
BOT_ACCOUNTS = 9           # comments of every ninth supplier come from an account of type Bot
# --------------------------------------------------------------------------------


def _owner_repo(key) -> F.Column:
    k = F.col(key)
    return F.concat(F.lit("org"), F.pmod(k, F.lit(OWNERS)).cast("string"), F.lit("/repo"),
                    F.pmod(k, F.lit(REPOS)).cast("string"))


def _state(c: str) -> F.Column:
    m = F.create_map(*[x for kv in ORDER_STATE.items() for x in map(F.lit, kv)])
    return F.coalesce(F.element_at(m, F.col(c)), F.lower(F.col(c)))


def pull_requests(spark: SparkSession, base: str) -> DataFrame:
    orders = load_table(spark, base, "orders")
    lines = load_table(spark, base, "lineitem")
    closed = lines.groupBy(F.col("l_orderkey").alias("id")) \
        .agg(F.max("l_shipdate").cast("timestamp").alias("closed_at"))
    prs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"),
        F.col("o_orderpriority").alias("agent"), _state("o_orderstatus").alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(F.lit(API_ROOT), _owner_repo("o_orderkey")).alias("repo_url"))
    prs = prs.join(closed, "id", "left")
    return prs.withColumn("merged_at", F.when(F.col("state") == "merged", F.col("closed_at")))


def task_types(spark: SparkSession, base: str) -> DataFrame:
    orders = load_table(spark, base, "orders").select("o_orderkey", "o_custkey")
    cust = load_table(spark, base, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(cust, orders.o_custkey == cust.c_custkey, "inner").select(
        F.col("o_orderkey").alias("id"), F.lower("c_mktsegment").alias("type"),
        F.lit(1.0).alias("confidence"))


def cleaned(texts: DataFrame, text: str = "text", keep_short: bool = False) -> DataFrame:
    """P11/P12 once per text, before any join multiplies it."""
    t = redistribute(texts).withColumn("clean_body", clean_text(text)).drop(text)
    return t if keep_short else where_here(t, long_enough("clean_body"))


def review_comments(spark: SparkSession, base: str, texts: DataFrame | None = None,
                    keep_all: bool = False) -> DataFrame:
    """Inline comments.  ``texts`` (doc_id and columns derived from the text)
    replaces the raw body; lines whose document it leaves out are dropped, or
    with ``keep_all`` stay without a text."""
    lines = load_table(spark, base, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    docs = load_table(spark, base, "documents").select("doc_id", F.col("text").alias("body"))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    lines = lines.withColumn("_doc", F.pmod(F.col("l_partkey"), n_docs))
    user = F.when(F.pmod(F.col("l_suppkey"), F.lit(10)) == 0,
                  F.concat(F.lit("ci-runner-"), F.col("l_suppkey").cast("string"), F.lit("[bot]"))) \
        .otherwise(F.concat(F.lit("dev"), F.col("l_suppkey").cast("string")))
    side = docs if texts is None else texts
    c = lines.join(side, lines["_doc"] == side["doc_id"], "left" if texts is None or keep_all else "inner")
    return c.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"),
        *[x for x in side.columns if x != "doc_id"], user.alias("user"),
        F.when(F.pmod(F.col("l_suppkey"), F.lit(BOT_ACCOUNTS)) == 0, F.lit("Bot")).otherwise(F.lit("User")).alias("user_type"),
        F.concat(F.lit(API_ROOT), _owner_repo("l_orderkey"), F.lit("/pulls/"),
                 F.col("l_orderkey").cast("string")).alias("pull_request_url"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"))


def reviews(spark: SparkSession, base: str, conv: DataFrame | None = None) -> DataFrame:
    """Reviews; ``conv`` can hold columns derived from the text instead of the text."""
    conv = load_table(spark, base, "conversations") if conv is None else conv
    derived = [c for c in conv.columns if c not in ("conv_id", "turn", "role", "text")]
    body = [F.col("text").alias("body")] if "text" in conv.columns else derived
    user = F.when(F.col("role") == "assistant", F.lit("copilot")) \
        .when(F.col("role") == "system", F.lit("system")) \
        .otherwise(F.concat(F.lit("reviewer"), F.col("conv_id").cast("string")))
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("pr_id"),
        user.alias("user"),
        F.when(F.col("role") == "system", F.lit("Bot")).otherwise(F.lit("User")).alias("user_type"),
        F.lit("COMMENTED").alias("review_state"), *body)


def domain_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {"prs": pull_requests(spark, base), "comments": review_comments(spark, base),
            "reviews": reviews(spark, base), "task_types": task_types(spark, base)}

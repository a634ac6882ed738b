"""The four (or six) domain tables as users have them: S1, S4, P1, J6.

Tables are Parquet folders or files: pull_request, pr_review_comments, pr_reviews, pr_task_type.
Columns are probed by their usual names, missing ones become null, and
timestamps given as strings are parsed at the source (a bad one is null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import assign_category, keyword_category, score_columns
from ..functions.text import as_ts
from ..operators.prep import Funnel, build_review_items, with_baseline
from .tables import table_path

# ---- fixed values: usual names of the columns, most usual first ----
COLUMN_NAMES = {
    "body": ("body", "comment", "review", "text", "content"),
    "user": ("user_name", "user", "author", "login"),
    "user_type": ("user_type", "author_type"),
    "created_at": ("created_at", "submitted_at"),
    "submitted_at": ("submitted_at", "created_at"),
    "agent": ("agent", "tool"),
    "pull_request_url": ("pull_request_url", "pr_url"),
}
PRS = ("id", "number", "agent", "state", "created_at", "merged_at", "closed_at", "repo_url")
COMMENTS = ("id", "body", "user", "user_type", "pull_request_url", "created_at")
REVIEWS = ("id", "pr_id", "body", "user", "user_type", "submitted_at")
TASK_TYPES = ("id", "type", "confidence")
TIMES = ("created_at", "merged_at", "closed_at", "submitted_at")
NUMBERS = ("id", "pr_id", "number")
# ---------------------------------------------------------------------


def with_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns, each from the first usual name that the table has."""
    out = []
    for name in names:
        have = [c for c in COLUMN_NAMES.get(name, (name,)) if c in df.columns]
        kind = "timestamp" if name in TIMES else "bigint" if name in NUMBERS else "double" if name == "confidence" else "string"
        c = F.col(have[0]) if have else F.lit(None)
        out.append((as_ts(c) if kind == "timestamp" else c.try_cast(kind)).alias(name))
    return df.select(*out)


def load_domain(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """prs, comments, reviews and task_types below ``base``."""
    read = lambda name, cols: with_columns(spark.read.parquet(table_path(base, name)), cols)
    return {"prs": read("pull_request", PRS), "comments": read("pr_review_comments", COMMENTS),
            "reviews": read("pr_reviews", REVIEWS), "task_types": read("pr_task_type", TASK_TYPES)}


def domain_items(spark: SparkSession, base: str, baseline: str | None = None,
                 funnel: Funnel | None = None) -> DataFrame:
    """Scored review items of the tables below ``base``.  ``baseline`` names the table
    of human pull requests (same columns); their items come through the same key
    joins and are stacked as agent Human.  ``funnel`` counts the steps of the first."""
    t = load_domain(spark, base)
    items = build_review_items(t["prs"], t["comments"], t["reviews"], t["task_types"], funnel=funnel)
    if baseline:
        human = with_columns(spark.read.parquet(table_path(base, baseline)), PRS)
        items = with_baseline(items, build_review_items(human, t["comments"], t["reviews"], t["task_types"]))
    s = score_columns(items, "clean_body")
    return s.withColumn("friction_category", assign_category("is_negative", keyword_category("clean_body")))

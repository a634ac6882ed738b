"""From raw tables to the unified review-item fact table.

Predicates are plain column expressions, so Catalyst pushes the PR filter
below both joins and column pruning reaches the parquet scans.  The two
item joins are left to the planner: sort-merge on the keys by default, AQE
turns them into broadcasts when a side proves small at run time and splits
skewed partitions (one PR with a third of all comments).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (MIN_TEXT_LENGTH, clean_text, duration_s, is_bot, keep_duration, long_enough,
                              pr_key_from_url, repo_from_url)
from ..session import where_here

ITEM_COLUMNS = ["id_pr", "item_id", "source", "clean_body", "agent", "pr_type", "created_at",
                "closed_at", "merged_at", "state", "item_created_at"]
SCORE_COLUMNS = ["friction_score", "sentiment_label", "is_negative", "friction_category"]
# what can stand for a text behind the joins that repeat it; texts kept elsewhere are found by text_md5
DIGEST_COLUMNS = ["clean_len", "text_md5"]
TEXT_COLUMNS = ["body", "clean_body", *DIGEST_COLUMNS, *SCORE_COLUMNS]


def drop_quick_close(prs: DataFrame, min_seconds: float = 60.0,
                     created: str = "created_at", closed: str = "closed_at") -> DataFrame:
    """Duration in seconds; drop closes under ``min_seconds``, keep open PRs."""
    d = prs.withColumn("pr_duration_seconds", duration_s(created, closed))
    return d.where(keep_duration("pr_duration_seconds", min_seconds))


def with_task_type(prs: DataFrame, tt: DataFrame, default: str = "unknown") -> DataFrame:
    """Left join of task types on id; missing -> 'unknown'.  Duplicate
    ids in ``tt`` multiply rows, as a keyed left join does."""
    t = tt.select("id", "type", *[c for c in ("confidence",) if c in tt.columns])
    return prs.join(t, "id", "left").withColumn("pr_type", F.coalesce(F.col("type"), F.lit(default)))


def comment_keys(comments: DataFrame, url: str = "pull_request_url") -> DataFrame:
    repo, num = pr_key_from_url(url)
    return comments.withColumn("repo_path", repo).withColumn("pr_number", num)


def pr_keys(prs: DataFrame, url: str = "repo_url") -> DataFrame:
    return prs.withColumn("repo_path", repo_from_url(url))


def _text_columns(items: DataFrame) -> list[str]:
    """The raw body, or what was derived from it once per text."""
    return [c for c in TEXT_COLUMNS if c in items.columns]


def _pr_side(prs: DataFrame) -> DataFrame:
    cols = ["id", "number", "repo_path", "agent", "pr_type", "created_at", "closed_at",
            "merged_at", "state"]
    return prs.select(*[F.col(c).alias(f"pr_{c}") if c in ("id", "number", "repo_path") else F.col(c)
                        for c in cols if c in prs.columns])


def join_comments(comments: DataFrame, prs: DataFrame) -> DataFrame:
    """Inner join on (owner/repo, number); null keys never match.
    Item columns are renamed up front instead of suffixing collisions."""
    # the keys are made once, behind the joins of the comments: pushed down as null
    # checks they would be made several times a row
    keyed = comment_keys(comments)
    keyed = where_here(keyed, F.col("repo_path").isNotNull() & F.col("pr_number").isNotNull())
    c = keyed.select(
        F.col("id").alias("item_id"), "user", "user_type", *_text_columns(comments),
        F.col("repo_path").alias("c_repo"), F.col("pr_number"),
        F.col("created_at").alias("item_created_at"))
    p = _pr_side(pr_keys(prs))
    cond = (F.col("c_repo") == F.col("pr_repo_path")) & (F.col("pr_number") == F.col("pr_num"))
    j = c.join(p.withColumnRenamed("pr_number", "pr_num"), cond, "inner")
    return j.withColumn("source", F.lit("comment")).withColumnRenamed("pr_id", "id_pr")


def join_reviews(reviews: DataFrame, prs: DataFrame) -> DataFrame:
    """Inner join reviews.pr_id = prs.id."""
    r = reviews.select(F.col("id").alias("item_id"), "pr_id", "user", "user_type", *_text_columns(reviews),
                       (F.col("submitted_at") if "submitted_at" in reviews.columns
                        else F.lit(None).cast("timestamp")).alias("item_created_at"))
    p = _pr_side(prs).withColumnRenamed("pr_id", "pid")
    j = r.join(p, F.col("pr_id") == F.col("pid"), "inner")
    return j.withColumn("source", F.lit("review")).withColumnRenamed("pr_id", "id_pr")


def drop_bots(items: DataFrame, user: str = "user", user_type: str | None = "user_type") -> DataFrame:
    """P8-P10."""
    ut = user_type if user_type and user_type in items.columns else None
    return items.where(~is_bot(user, ut))


def clean_and_filter(items: DataFrame, body: str = "body", out: str = "clean_body") -> DataFrame:
    """P11/P12.  Texts that were cleaned before (once per text), or are represented by
    their digests, stay as they are."""
    if out in items.columns or "clean_len" in items.columns:
        return items
    return items.withColumn(out, clean_text(body)).where(long_enough(out))


def combine(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; a column missing on one side is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def project_items(df: DataFrame) -> DataFrame:
    """The common item columns that exist, agent defaulted."""
    d = df.withColumn("agent", F.coalesce(F.col("agent"), F.lit("Unknown_AI")))
    if "pr_type" not in d.columns:
        d = d.withColumn("pr_type", F.lit("unknown"))
    return d.select(*[c for c in ITEM_COLUMNS + DIGEST_COLUMNS + SCORE_COLUMNS if c in d.columns])


# ---- fixed values: the steps of a run, in order, for each table ----
FUNNEL_STEPS = {"prs": ("input", "not_quick_close"), "comments": ("input", "joined", "not_bot", "long_enough"),
                "reviews": ("input", "joined", "not_bot", "long_enough")}
# --------------------------------------------------------------------


@dataclass
class Funnel:
    """Rows that each step of a run keeps, counted by the pass that computes the
    items (``DataFrame.observe``), without another scan.

    The counts are there once an action over all items is done, such as the write of
    the facts.  They add up what tasks report: steps in front of a shuffle count the
    rows of a task again if a lost executor makes Spark run that task once more."""
    seen: list[tuple[str, Observation, DataFrame]] = field(default_factory=list)

    def watch(self, df: DataFrame, table: str, **steps: Column) -> DataFrame:
        """``df``, counting the rows for which each step's condition is true."""
        o, counts = Observation(), [F.count(F.when(c, F.lit(1))).alias(name) for name, c in steps.items()]
        self.seen.append((table, o, df.agg(*counts)))
        return df.observe(o, *counts)

    def counts(self) -> list[tuple[str, int, str, int]]:
        """(table, step_no, step, n_rows); waits for the action.

        Where the optimizer left a step out of the plan, because a join met an empty
        side, its rows are counted by a query of their own."""
        got: dict[str, dict[str, int]] = {}
        for table, o, again in self.seen:
            observed = o._jo.getRow().length() > 0
            got.setdefault(table, {}).update(o.get if observed else again.first().asDict())
        return [(table, i, step, got[table][step]) for table, steps in FUNNEL_STEPS.items() if table in got
                for i, step in enumerate(steps)]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), "source_table string, step_no int, step string, n_rows long")


def _watched_items(items: DataFrame, funnel: Funnel, table: str, user_type: str | None) -> DataFrame:
    """Bot and length steps as flags of one row each, counted together."""
    if "clean_len" in items.columns:
        enough = F.col("clean_len") > F.lit(MIN_TEXT_LENGTH)
    else:
        if "clean_body" not in items.columns:
            items = items.withColumn("clean_body", clean_text("body"))
        enough = long_enough("clean_body")
    person = ~is_bot("user", user_type if user_type and user_type in items.columns else None)
    kept = person & F.coalesce(enough, F.lit(False))
    return funnel.watch(items, table, joined=F.lit(True), not_bot=person, long_enough=kept).where(kept)


def build_review_items(prs: DataFrame, comments: DataFrame, reviews: DataFrame, task_types: DataFrame,
                       min_seconds: float = 60.0, funnel: Funnel | None = None) -> DataFrame:
    """Entry 2 of the reference: raw tables -> unified review items.  With a ``funnel``
    the rows of every step are counted on the way; texts must not be cut by length
    before then."""
    p = with_task_type(drop_quick_close(prs, min_seconds), task_types)
    # the account type marks bots among reviewers only
    if funnel is None:
        mc = clean_and_filter(drop_bots(join_comments(comments, p), user_type=None))
        mr = clean_and_filter(drop_bots(join_reviews(reviews, p)))
        return combine(project_items(mc), project_items(mr))
    timed = prs.withColumn("pr_duration_seconds", duration_s("created_at", "closed_at"))
    keep = keep_duration("pr_duration_seconds", min_seconds)
    # pull requests feed both joins; one side of them counts
    counted = with_task_type(funnel.watch(timed, "prs", input=F.lit(True), not_quick_close=keep).where(keep), task_types)
    comments = funnel.watch(comments, "comments", input=F.lit(True))
    reviews = funnel.watch(reviews, "reviews", input=F.lit(True))
    mc = _watched_items(join_comments(comments, counted), funnel, "comments", None)
    mr = _watched_items(join_reviews(reviews, p), funnel, "reviews", "user_type")
    return combine(project_items(mc), project_items(mr))


def with_baseline(items: DataFrame, human_items: DataFrame, label: str = "Human") -> DataFrame:
    """Human-authored items tagged with ``agent = 'Human'`` and stacked."""
    return combine(items, human_items.withColumn("agent", F.lit(label)))

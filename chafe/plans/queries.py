"""Registered analysis queries over the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``oracle_sql.ORACLE``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as A
from ..sources.tables import load_table, quality_funnel
from ..session import scratch_table
from ..functions.lexicon import score_columns
from .common import (clean_documents, counted_items, review_items, rounded, scored_documents, scored_items,
                     with_category)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query.  Timestamps in the tables are zone-less wall-clock
    values, so every query runs with the session time zone pinned to UTC
    (the driver may hand over a session with another default)."""
    def deco(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, d)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---- flagship: clean -> score -> friction per group ------------------------------
@register("friction_by_group")
def friction_by_group(spark, d):
    s = scored_documents(spark, d)
    return rounded(A.group_summary(s, "source"))


@register("friction_by_agent")
def friction_by_agent(spark, d):
    return rounded(A.group_summary(scored_items(spark, d), "agent"))


@register("clean_text_len")
def clean_text_len(spark, d):
    docs = clean_documents(spark, d)
    conv = load_table(spark, d, "conversations")
    c = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
                    F.col("role").alias("source"), tx.clean_text("text").alias("clean_body")) \
        .where(tx.long_enough("clean_body"))
    both = docs.select("doc_id", "source", "clean_body").unionByName(c)
    return both.select("doc_id", "source", F.length("clean_body").alias("clean_len"),
                       F.md5("clean_body").alias("clean_md5"))


# ---- prep: keys, filters, joins, union -----------------------------------------
from ..operators import prep as P  # noqa: E402
from ..operators import stats as X  # noqa: E402
from ..operators import distributions as Dn  # noqa: E402
from ..sources import adapters as AD  # noqa: E402


@register("url_keys")
def url_keys(spark, d):
    c = AD.review_comments(spark, d).select(F.col("id"), F.col("pull_request_url").alias("url"))
    pages = load_table(spark, d, "pages").select((-F.col("page_id") - 1).alias("id"), "url")
    u = c.unionByName(pages)
    repo, num = tx.pr_key_from_url("url")
    return u.select("id", repo.alias("repo_path"), num.alias("pr_number"))


@register("repo_keys")
def repo_keys(spark, d):
    return AD.pull_requests(spark, d).select("id", tx.repo_from_url("repo_url").alias("repo_path"))


@register("quick_close_filter")
def quick_close_filter(spark, d):
    kept = P.drop_quick_close(AD.pull_requests(spark, d))
    return rounded(kept.select("id", "pr_duration_seconds"))


@register("task_type_join")
def task_type_join(spark, d):
    prs = P.with_task_type(P.drop_quick_close(AD.pull_requests(spark, d)), AD.task_types(spark, d))
    return A.value_counts(prs, "pr_type")


@register("items_union")
def items_union(spark, d):
    it = review_items(spark, d)
    return it.select("item_id", "source", "id_pr", "agent", "pr_type", "state",
                     "clean_len", F.col("text_md5").alias("clean_md5"))


def _human_split(items):
    # the baseline is relabelled in place: the pipeline runs once
    return items.withColumn("agent", F.when(F.col("agent") == "5-LOW", "Human").otherwise(F.col("agent")))


@register("baseline_union")
def baseline_union(spark, d):
    return rounded(A.group_summary(_human_split(scored_items(spark, d)), "agent"))


@register("bot_filter")
def bot_filter(spark, d):
    c = AD.review_comments(spark, d).select(F.lit("comment").alias("source"), "user", "user_type")
    r = AD.reviews(spark, d).select(F.lit("review").alias("source"), "user", "user_type")
    u = c.unionByName(r).withColumn("is_bot", tx.is_bot("user", "user_type"))
    return u.groupBy("source", "is_bot").agg(F.count(F.lit(1)).alias("n"))


@register("quality_funnel")
def quality_funnel_q(spark, d):
    docs = load_table(spark, d, "documents")
    scored = docs.withColumn("clean_body", tx.clean_text("text"))
    from ..functions.lexicon import argmax_label, lexicon_probs
    steps = [("has_text", F.col("text").isNotNull()),
             ("long_enough", tx.long_enough("clean_body")),
             ("negative", argmax_label(lexicon_probs("clean_body")) == "negative")]
    return quality_funnel(scored, steps)


@register("pipeline_funnel")
def pipeline_funnel(spark, d):
    """Quick-close, join, bot and length steps of both sources, counted by the pass
    that writes the facts; texts are written once, not with every item."""
    items, funnel = counted_items(spark, d, texts_apart=True)
    scratch_table(items)
    return funnel.frame(spark)


# ---- aggregates ---------------------------------------------------------------
@register("value_counts")
def value_counts_q(spark, d):
    return A.value_counts(load_table(spark, d, "events"), "event_type")


@register("shares")
def shares_q(spark, d):
    return rounded(A.shares(load_table(spark, d, "events"), "event_type"))


@register("sentiment_summary")
def sentiment_summary_q(spark, d):
    return rounded(A.sentiment_summary(scored_items(spark, d), "source"))


@register("sentiment_by_source")
def sentiment_by_source_q(spark, d):
    return rounded(A.sentiment_by_source(scored_items(spark, d)))


def _with_merged(df):
    return df.withColumn("is_merged", tx.merged_flag("state"))


@register("merge_rates")
def merge_rates_q(spark, d):
    return rounded(A.merge_rates(_with_merged(scored_items(spark, d))))


@register("category_counts")
def category_counts_q(spark, d):
    return rounded(A.category_counts(scored_items(spark, d)))


@register("category_stats")
def category_stats_q(spark, d):
    return rounded(A.category_stats(scored_items(spark, d)))


AGENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("category_matrix")
def category_matrix_q(spark, d):
    s = scored_items(spark, d).where(F.col("friction_category") != "N/A")
    return A.count_matrix(s, "friction_category", "agent", values=AGENTS)


@register("category_share")
def category_share_q(spark, d):
    s = scored_items(spark, d).where(F.col("friction_category") != "N/A")
    return rounded(A.column_share(s, "friction_category", "agent"))


@register("monthly_trend")
def monthly_trend_q(spark, d):
    return rounded(A.monthly_trend(scored_items(spark, d), "created_at"))


def _with_hours(df, end="merged_at"):
    h = tx.duration_h("created_at", end)
    return df.withColumn("time_to_merge_hours", h).where(tx.valid_hours("time_to_merge_hours"))


@register("per_pr_time")
def per_pr_time_q(spark, d):
    return rounded(A.per_pr_time(_with_hours(scored_items(spark, d))))


@register("per_pr_iterations")
def per_pr_iterations_q(spark, d):
    return rounded(A.per_pr_iterations(scored_items(spark, d), text="item_id"))


@register("label_counts")
def label_counts_q(spark, d):
    return A.label_counts(scored_items(spark, d), "source")


@register("mean_matrix_source")
def mean_matrix_source_q(spark, d):
    return rounded(A.mean_matrix(scored_items(spark, d), "agent", "source",
                                 values=["comment", "review"], diff=("comment", "review")))


@register("mean_matrix_type")
def mean_matrix_type_q(spark, d):
    return rounded(A.mean_matrix(scored_items(spark, d), "pr_type", "agent", values=AGENTS))


@register("negative_rate")
def negative_rate_q(spark, d):
    return rounded(A.negative_rate(scored_items(spark, d)))


@register("type_stats")
def type_stats_q(spark, d):
    return rounded(A.pr_type_stats(scored_items(spark, d)))


@register("top_topics")
def top_topics_q(spark, d):
    s = scored_documents(spark, d)
    counts = A.count_long(s, "lang", "source")
    return A.top_k(counts, "source", "lang", k=3)


def _pr_outcomes(spark, d):
    s = _with_merged(scored_items(spark, d))
    s = s.withColumn("time_to_merge_hours", tx.duration_h("created_at", "closed_at"))
    return s.groupBy("id_pr").agg(F.avg("friction_score").alias("friction_score"),
                                  F.count("item_id").alias("comment_count"),
                                  F.any_value("time_to_merge_hours").alias("time_to_merge_hours"),
                                  F.max("is_merged").alias("is_merged"))


@register("band_outcomes")
def band_outcomes_q(spark, d):
    return rounded(A.band_outcomes(_pr_outcomes(spark, d)))


@register("quartile_contrast")
def quartile_contrast_q(spark, d):
    return rounded(A.quartile_contrast(_pr_outcomes(spark, d)))


@register("band_counts")
def band_counts_q(spark, d):
    return A.band_counts(scored_items(spark, d))


@register("triage")
def triage_q(spark, d):
    s = scored_items(spark, d).where(tx.triage("friction_score"))
    return s.groupBy("agent").agg(F.count(F.lit(1)).alias("n_triage"))


# ---- statistics -------------------------------------------------------------------
STAT_COLS = ["test", "n", "dof", "statistic"]


def _stat(df, cols=STAT_COLS):
    return rounded(df.select(*cols))


@register("kruskal_events")
def kruskal_events(spark, d):
    return _stat(X.kruskal(load_table(spark, d, "events"), "event_type", "value", test="kruskal_events"))


@register("kruskal_agents")
def kruskal_agents(spark, d):
    return _stat(X.kruskal(scored_items(spark, d), "agent", "friction_score", test="kruskal_agents"))


@register("kruskal_categories")
def kruskal_categories(spark, d):
    s = scored_items(spark, d).where(F.col("friction_category") != "N/A")
    return _stat(X.kruskal(s, "friction_category", "friction_score", test="kruskal_categories"))


@register("mann_whitney_pairs")
def mann_whitney_pairs_q(spark, d):
    r = X.mann_whitney_pairs(load_table(spark, d, "events"), "event_type", "value")
    return rounded(r.select("pair", "group_a", "group_b", "n_a", "n_b", "statistic"))


@register("mann_whitney_two")
def mann_whitney_two_q(spark, d):
    s = _human_split(scored_items(spark, d))
    r = X.mann_whitney(s, F.col("agent") == "Human", "friction_score")
    return rounded(r.select("pair", "n_a", "n_b", "statistic"))


@register("point_biserial")
def point_biserial_q(spark, d):
    s = scored_documents(spark, d).join(load_table(spark, d, "labels"), "doc_id")
    return _stat(X.point_biserial(s, "friction_score", "toxic"), ["test", "n", "statistic"])


@register("chi2_category_agent")
def chi2_category_agent(spark, d):
    s = scored_items(spark, d).where(F.col("friction_category") != "N/A")
    return _stat(X.chi2_independence(s, "friction_category", "agent", test="chi2_category_agent"))


@register("chi2_lang_source")
def chi2_lang_source(spark, d):
    s = load_table(spark, d, "documents")
    return _stat(X.chi2_independence(s, "lang", "source", test="chi2_lang_source"))


@register("spearman_time")
def spearman_time(spark, d):
    pr = A.per_pr_time(_with_hours(scored_items(spark, d)))
    return _stat(X.spearman(pr, "friction_score", "time_to_merge_hours", test="spearman_time"),
                 ["test", "n", "statistic"])


@register("spearman_iterations")
def spearman_iterations(spark, d):
    pr = A.per_pr_iterations(scored_items(spark, d), text="item_id")
    return _stat(X.spearman(pr, "friction_score", "comment_count", test="spearman_iterations"),
                 ["test", "n", "statistic"])


@register("spearman_by_group")
def spearman_by_group(spark, d):
    ev = X.days_since_first(load_table(spark, d, "events"), "ts", ["event_type"])
    r = X.spearman_by(ev, "event_type", "time_numeric", "value")
    return rounded(r.select("event_type", "n", "statistic"))


@register("tests_table")
def tests_table(spark, d):
    ev = load_table(spark, d, "events")
    ev = ev.withColumn("is_click", (F.col("event_type") == "click").cast("int"))
    long = X.tests_long(X.kruskal(ev, "event_type", "value", test="kruskal_events"),
                        X.chi2_independence(ev.withColumn("hour", F.hour("ts")), "event_type", "hour",
                                            test="chi2_type_hour"),
                        X.point_biserial(ev, "value", "is_click"),
                        X.spearman(ev, "user_id", "value", test="spearman_user_value"))
    return long


@register("tests_wide")
def tests_wide_q(spark, d):
    long = tests_table(spark, d)
    return X.tests_wide(long, ["kruskal_events", "chi2_type_hour", "pointbiserial",
                               "spearman_user_value"])


# ---- distributions -----------------------------------------------------------------
@register("box_stats")
def box_stats_q(spark, d):
    return rounded(Dn.box_stats(load_table(spark, d, "events"), "event_type", "value"))


@register("box_stats_agents")
def box_stats_agents(spark, d):
    return rounded(Dn.box_stats(scored_items(spark, d), "agent", "friction_score"))


@register("histogram")
def histogram_q(spark, d):
    return rounded(Dn.histogram(load_table(spark, d, "events"), "event_type", "value"))


@register("density")
def density_q(spark, d):
    return rounded(Dn.density(load_table(spark, d, "events"), "event_type", "value"))


# ---- topics --------------------------------------------------------------------
from ..operators import scoring as U  # noqa: E402
from ..operators import topics as Tp  # noqa: E402
from ..operators.cosine import cosine_pairs  # noqa: E402
from ..operators.topic_map import distance_outliers  # noqa: E402


@register("topic_terms")
def topic_terms_q(spark, d):
    return Tp.topic_terms(clean_documents(spark, d), "clean_body", "source")


@register("ctfidf_top")
def ctfidf_top_q(spark, d):
    sc = Tp.ctfidf(Tp.term_counts(clean_documents(spark, d), "clean_body", "source"), "source")
    return rounded(Tp.top_terms(sc, "source", 10))


@register("topic_info")
def topic_info_q(spark, d):
    return Tp.topic_info(clean_documents(spark, d), "clean_body", "source", "doc_id")


@register("topic_clusters")
def topic_clusters(spark, d):
    emb = load_table(spark, d, "embeddings")
    model = Tp.fit_topic_model(emb, "embedding")
    t = Tp.assign_topics(model, emb)
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"),
                                  F.countDistinct("label").alias("n_labels"))


@register("topic_agent_matrix")
def topic_agent_matrix(spark, d):
    """A11 on fitted clusters: embeddings' topics x label as the agent."""
    emb = load_table(spark, d, "embeddings")
    t = Tp.assign_topics(Tp.fit_topic_model(emb, "embedding"), emb)
    t = t.where(F.col("topic") != Tp.OUTLIER_TOPIC)
    return A.count_matrix(t, "topic", "label")


@register("topic_numbers_kept")
def topic_numbers_kept(spark, d):
    """Topics of a saved and loaded model, assigned in two parts, against the fitted ones."""
    from pyspark.ml import PipelineModel
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import save_model
    emb = load_table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    model = Tp.fit_topic_model(emb, "embedding")
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    save_model(model, path)
    loaded = PipelineModel.load(path)
    fitted = scratch_table(Tp.assign_topics(model, emb).select("vec_id", F.col("topic").alias("fitted")))
    half = F.pmod(F.col("vec_id"), F.lit(2)) == 0
    parts = Tp.assign_topics(loaded, emb.where(half)).unionByName(Tp.assign_topics(loaded, emb.where(~half)))
    both = scratch_table(parts.select("vec_id", "topic")).join(fitted, "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("topic") != F.col("fitted"), 1)).alias("n_changed"))


@register("distance_outliers")
def distance_outliers_q(spark, d):
    """Each label's embeddings beyond the 95 % quantile of the distances from their mean."""
    rows = distance_outliers(load_table(spark, d, "embeddings"), "embedding", "label")
    return rounded(rows.where(F.col("distance").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_outlier"), 1)).alias("n_outliers"),
        F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")))


@register("topic_cosine")
def topic_cosine(spark, d):
    """T4: pairs of (language, source) topics whose c-TF-IDF vectors have cosine >= 0.5."""
    docs = clean_documents(spark, d).withColumn("topic", F.concat_ws("/", "lang", "source"))
    return rounded(cosine_pairs(Tp.ctfidf(Tp.term_counts(docs, "clean_body", "topic"), "topic"), "topic", 0.5))


@register("topics_by_source")
def topics_by_source(spark, d):
    """T1-T10 on the documents that score negative: each source's top topics and their words."""
    docs = Tp.negatives(scored_documents(spark, d)).select("doc_id", "source", "clean_body")
    study = Tp.topic_study(docs, "clean_body", "source", "doc_id")
    return study.top


@register("box_stats_agent_source")
def box_stats_agent_source(spark, d):
    return rounded(Dn.box_stats(scored_items(spark, d), ["agent", "source"], "friction_score"))


@register("label_counts_agent")
def label_counts_agent(spark, d):
    return A.label_counts(scored_items(spark, d), "agent")


@register("tests_six")
def tests_six(spark, d):
    """X11: the six named tests over the scored items, statistics and p-values."""
    from ..session import cut_lineage
    s = cut_lineage(_with_merged(scored_items(spark, d)).select(
        "id_pr", "item_id", "agent", "created_at", "merged_at", "is_merged", "friction_score", "friction_category"))
    neg = s.where(F.col("friction_category") != "N/A")
    return rounded(X.tests_long(
        X.kruskal(s, "agent", "friction_score", test="kruskal_wallis_agents"),
        X.point_biserial(s, "friction_score", "is_merged", test="pointbiserial"),
        X.spearman(A.per_pr_time(_with_hours(s)), "friction_score", "time_to_merge_hours", test="time_to_merge"),
        X.spearman(A.per_pr_iterations(s, text="item_id"), "friction_score", "comment_count", test="iterations"),
        X.kruskal(neg, "friction_category", "friction_score", test="kruskal_wallis_categories"),
        X.chi2_independence(neg, "friction_category", "agent", test="chi2_category_agent")))


@register("topic_merge")
def topic_merge(spark, d):
    sc = Tp.ctfidf(Tp.term_counts(clean_documents(spark, d), "clean_body", "lang"), "lang")
    return Tp.merge_topics(sc, "lang")


# ---- model scoring ----------------------------------------------------------------
@register("model_score")
def model_score(spark, d):
    s = U.score_sentiment(clean_documents(spark, d), "clean_body")
    return rounded(A.group_summary(s, "source"))


@register("model_category")
def model_category(spark, d):
    s = U.score_sentiment(clean_documents(spark, d), "clean_body").where(F.col("is_negative"))
    c = U.classify(s, "clean_body")
    return c.groupBy("friction_category").agg(F.count(F.lit(1)).alias("count"))


@register("trained_score")
def trained_score(spark, d):
    from ..session import group_side
    docs = scratch_table(clean_documents(spark, d).select("doc_id", "source", "clean_body"))
    lab = docs.join(group_side(load_table(spark, d, "labels").select("doc_id", "toxic")), "doc_id")
    model = U.fit_scorer(lab, "clean_body", "toxic")
    s = U.apply_scorer(model, docs)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.col("is_negative").cast("int")).alias("n_negative"))


@register("mean_matrix_type_source")
def mean_matrix_type_source(spark, d):
    return rounded(A.mean_matrix(scored_items(spark, d), "pr_type", "source",
                                 values=["comment", "review"]))


@register("spearman_temporal_agents")
def spearman_temporal_agents(spark, d):
    """X8 on the item pipeline: days since the agent's first item vs friction."""
    s = scored_items(spark, d).where(F.col("created_at").isNotNull())
    s = X.days_since_first(s.select("agent", "created_at", "friction_score"), "created_at", ["agent"])
    return rounded(X.spearman_by(s, "agent", "time_numeric", "friction_score")
                   .select("agent", "n", "statistic"))


# ---- report ------------------------------------------------------------------------
@register("summary_report")
def summary_report(spark, d):
    """The run summary lines over the scored items and the rank tests."""
    from ..session import cut_lineage
    from ..sources.sinks import results_long, summary_lines
    # five consumers below: score once, keep what they read
    s = cut_lineage(scored_items(spark, d).select("agent", "source", "friction_score", "is_negative", "pr_type",
                                                  "sentiment_label", "friction_category", "id_pr"))
    tests = results_long({"kruskal_agents": X.kruskal(s, "agent", "friction_score")})
    return summary_lines(s, tests)


# ---- vectors, labels, sketches, samples, ordered groups -----------------------------
@register("embedded_documents")
def embedded_documents(spark, d):
    """A document's own embedding where one was computed before, else the offline letter
    model; both under the width contract."""
    emb = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("given"))
    docs = load_table(spark, d, "documents").select("doc_id", "text").join(emb, "doc_id", "left")
    e = U.embed(docs, "text", U.make_letter_shares(64), 64, precomputed="given")
    return rounded(e.groupBy("embedding_source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.element_at("embedding", 1)).alias("mean_first"),
        F.avg(F.element_at("embedding", 5)).alias("mean_fifth"), F.max(F.size("embedding")).alias("width")))


@register("label_similarity_category")
def label_similarity_category(spark, d):
    """Negative documents by the label prompt they are most similar to; the keyword rule
    decides only where no label is nearer than another (U8)."""
    labels = list(U.CATEGORY_KEYWORDS)
    s = scored_documents(spark, d).where(F.col("is_negative")).select("doc_id", "clean_body")
    c = U.classify(s, "clean_body", labels, make_predict_fn=U.make_label_similarity(labels), batch_size=64)
    return c.select("doc_id", "friction_category")


@register("box_stats_sketched")
def box_stats_sketched_q(spark, d):
    """D1 at scale: whether the sketched quartiles' ranks are within 2 % of the exact ones."""
    ev, qs, names = load_table(spark, d, "events"), [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    sketches = scratch_table(Dn.quantile_sketches(ev, "event_type", "value"))
    errors = Dn.rank_errors(ev, "event_type", "value", Dn.sketch_quantiles(sketches, "event_type", qs, names), qs, names)
    return errors.groupBy("event_type").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_quantiles"),
                                            (F.max("rank_error") <= 0.02).alias("within_bound"))


@register("sample_points")
def sample_points_q(spark, d):
    """200 points of each event type for a scatter plot, the same for any partitioning."""
    ev = load_table(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(Dn.sample_points(ev, "event_type", "event_id", 200))


@register("ordered_groups")
def ordered_groups_q(spark, d):
    """Agents in the order of the figures, the baseline first."""
    return A.ordered_groups(AD.pull_requests(spark, d), "agent", first=["5-LOW", "3-MEDIUM", "none such"])


@register("baseline_joins")
def baseline_joins(spark, d):
    """Human pull requests are a table of their own and come through the same key joins."""
    def derive(t):
        return with_category(score_columns(t, "clean_body"))
    docs = derive(AD.cleaned(load_table(spark, d, "documents").select("doc_id", "text")))
    conv = derive(AD.cleaned(load_table(spark, d, "conversations")))
    prs, tt = AD.pull_requests(spark, d), AD.task_types(spark, d)
    human = F.col("agent") == "5-LOW"
    comments, reviews = AD.review_comments(spark, d, docs), AD.reviews(spark, d, conv)
    items = P.with_baseline(P.build_review_items(prs.where(~human), comments, reviews, tt),
                            P.build_review_items(prs.where(human), comments, reviews, tt))
    return rounded(A.group_summary(items, "agent"))


@register("top_labels_by_source")
def top_labels_by_source(spark, d):
    """A11/A22 on given topics: each source's three most frequent embedding labels."""
    emb = load_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    docs = load_table(spark, d, "documents").select("doc_id", "source")
    return A.top_k(A.count_matrix(docs.join(emb, "doc_id"), "topic", "source"), "source", "topic", k=3)


@register("monthly_trend_reviews")
def monthly_trend_reviews(spark, d):
    """A10 over reviews only."""
    return rounded(A.monthly_trend(scored_items(spark, d), "created_at", min_n=1, reviews_only=True))


@register("temporal_trend_agents")
def temporal_trend_agents(spark, d):
    """X8 with the guard of P25: agents with at least ten timestamps."""
    return rounded(X.temporal_trend(scored_items(spark, d), "created_at", "agent", "friction_score")
                   .select("agent", "n", "statistic"))


@register("merge_rates_by_time")
def merge_rates_by_time(spark, d):
    """Merged means that a merge time exists."""
    return rounded(A.merge_rates(scored_items(spark, d).withColumn("is_merged", tx.merged_at_flag("merged_at"))))


@register("chi2_two_by_two")
def chi2_two_by_two(spark, d):
    """X5 with one degree of freedom, where Yates' correction applies."""
    ev = load_table(spark, d, "events").where(F.col("event_type").isNotNull() & F.col("value").isNotNull())
    ev = ev.select((F.col("event_type") == "click").alias("is_click"), (F.col("value") > 50).alias("is_large"))
    return _stat(X.chi2_independence(ev, "is_click", "is_large", test="chi2_two_by_two"))


@register("tests_six_statistics")
def tests_six_statistics(spark, d):
    """X11: the six named tests' rows and statistics (``tests_six`` adds the p-values)."""
    return rounded(tests_six(spark, d).select("test", "n", "statistic"))

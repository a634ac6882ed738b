"""Every step's rows, counted by the pass that writes the facts."""

import pytest

from chafe.functions.text import duration_s
from chafe.operators import prep as P
from chafe.plans.common import counted_items, scored_items
from chafe.session import scratch_table
from chafe.sources.sinks import write_facts

SF = "/root/testdata/sf0.001"
URL = "https://api.github.com/repos/o/r/pulls/"


@pytest.fixture
def tables(spark):
    prs = spark.createDataFrame(
        [(1, 1, "a", "open", "2024-01-01 00:00:00", None, None), (2, 2, "a", "closed", "2024-01-01 00:00:00", None, "2024-01-01 00:00:30"),
         (3, 3, None, "closed", "2024-01-01 00:00:00", None, "2024-01-02 00:00:00")],
        "id long, number long, agent string, state string, created_at string, merged_at string, closed_at string") \
        .selectExpr("*", "'https://api.github.com/repos/o/r' AS repo_url")
    comments = spark.createDataFrame(
        [(10, "a long enough text", "dev", "User", URL + "1"), (11, "short", "dev", "User", URL + "1"),
         (12, "a long enough text", "x[bot]", "User", URL + "3"), (13, "a long enough text", "dev", "Bot", URL + "3"),
         (14, "a long enough text", "dev", "User", URL + "2"), (15, None, None, None, URL + "3"), (16, "a long enough text", "d", "User", None)],
        "id long, body string, user string, user_type string, pull_request_url string") \
        .selectExpr("*", "CAST(NULL AS timestamp) AS created_at")
    reviews = spark.createDataFrame(
        [(20, 1, "a long enough text", "dev", "User"), (21, 3, "a long enough text", "dev", "Bot"), (22, 9, "no request at all", "d", "User")],
        "id long, pr_id long, body string, user string, user_type string")
    types = spark.createDataFrame([(1, "fix", 1.0)], "id long, type string, confidence double")
    return prs, comments, reviews, types


def test_counts_of_small_tables(spark, tables):
    funnel = P.Funnel()
    items = scratch_table(P.build_review_items(*tables, funnel=funnel))
    want = {("prs", "input"): 3, ("prs", "not_quick_close"): 2, ("comments", "input"): 7, ("comments", "joined"): 5,
            ("comments", "not_bot"): 4, ("comments", "long_enough"): 2, ("reviews", "input"): 3, ("reviews", "joined"): 2,
            ("reviews", "not_bot"): 1, ("reviews", "long_enough"): 1}
    got = funnel.frame(spark).collect()
    assert {(r.source_table, r.step): r.n_rows for r in got} == want
    assert [r.step_no for r in got] == [0, 1, 0, 1, 2, 3, 0, 1, 2, 3]
    plain = P.build_review_items(*tables)
    assert sorted(map(str, items.collect())) == sorted(map(str, plain.collect()))
    assert items.count() == want["comments", "long_enough"] + want["reviews", "long_enough"]


def test_empty_tables(spark, tables):
    funnel = P.Funnel()
    scratch_table(P.build_review_items(*(t.where("false") for t in tables), funnel=funnel))
    assert all(n == 0 for *_, n in funnel.counts()) and len(funnel.counts()) == 10
    prs, comments, reviews, types = tables
    funnel = P.Funnel()
    scratch_table(P.build_review_items(prs, comments.where("false"), reviews, types, funnel=funnel))
    counts = {(t, s): n for t, _, s, n in funnel.counts()}
    assert counts["prs", "input"] == 3 and counts["comments", "input"] == 0 and counts["reviews", "long_enough"] == 1


def test_facts_equal_the_uncounted_items_and_need_no_other_scan(spark):
    items, funnel = counted_items(spark, SF)
    facts = scratch_table(items)
    plain = scored_items(spark, SF)
    columns = ["item_id", "source", "agent", "friction_score", "friction_category"]
    assert facts.select(*columns).exceptAll(plain.select(*columns)).isEmpty() and facts.count() == plain.count()
    counts = {(t, s): n for t, _, s, n in funnel.counts()}
    assert counts["comments", "long_enough"] + counts["reviews", "long_enough"] == facts.count()
    # the counts sit in the plan of the write: one for each watched step
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 5


def test_bucketed_facts_need_no_shuffle_on_their_key(spark):
    """J2/J3 -> A12/A13/X6/X7: joins and aggregates by pull request read the buckets."""
    from chafe.operators import aggregates as A
    facts = write_facts(scored_items(spark, SF), "facts_by_pr", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = A.per_pr_iterations(facts, text="item_id")
        t = A.per_pr_time(facts.withColumn("time_to_merge_hours", duration_s("created_at", "merged_at")))
        both = n.join(t.select("id_pr", "time_to_merge_hours"), "id_pr")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = {r.id_pr: r.comment_count for r in A.per_pr_iterations(scored_items(spark, SF), text="item_id").collect()}
        assert {r.id_pr: r.comment_count for r in both.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE facts_by_pr")

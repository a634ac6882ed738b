"""The whole study in one run: ``python -m chafe.study --data DIR --out DIR``.

Raw tables -> scored review items (written once, read by every analysis)
-> result tables, the statistical tests, the summary text and the fitted
topic model under ``--out``.  Each analysis is an ordinary DataFrame job;
results are small aggregates written as one CSV each.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import aggregates as A
from .operators import distributions as Dn
from .operators import stats as X
from .operators import topics as Tp
from .operators.prep import Funnel
from .plans.common import counted_items
from .session import build_session, cut_lineage
from .sources import sinks as S
from .sources.domain import domain_items
from .sources.tables import require_rows


def run_study(spark: SparkSession, data: str, out: str, domain: bool = False, baseline: str | None = None) -> dict:
    """``domain``: the folder holds the domain tables themselves (``sources.domain``),
    with ``baseline`` naming the table of human pull requests, if any."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    funnel = Funnel()
    if domain:
        source = domain_items(spark, data, baseline, funnel)
    else:
        source, funnel = counted_items(spark, data)
    # the scored facts are an output, and what every analysis below reads
    paths = {k: f"{out}/facts/{k}" for k in ("combined", "comment", "review")}
    source.write.mode("overwrite").parquet(paths["combined"])
    items = require_rows(spark.read.parquet(paths["combined"]), "review items")
    for k in ("comment", "review"):
        items.where(F.col("source") == k).write.mode("overwrite").parquet(paths[k])
    items = items.withColumn("is_merged", tx.merged_flag("state"))
    neg = items.where(F.col("friction_category") != "N/A")
    timed = items.withColumn("time_to_merge_hours", tx.duration_h("created_at", "merged_at")) \
        .where(tx.valid_hours("time_to_merge_hours"))
    per_pr_time = cut_lineage(A.per_pr_time(timed))
    per_pr_iter = cut_lineage(A.per_pr_iterations(items))

    results = {
        "row_funnel": funnel.frame(spark),
        "friction_stats_by_agent": A.group_summary(items, "agent"),
        "sentiment_by_source": A.sentiment_by_source(items),
        "merge_rates": A.merge_rates(items),
        "category_counts": A.category_counts(items),
        "category_friction_stats": A.category_stats(items),
        "category_agent_matrix": A.count_matrix(neg, "friction_category", "agent"),
        "temporal_trends": A.monthly_trend(items, "created_at"),
        "pr_type_stats": A.pr_type_stats(items),
        "friction_box_by_agent": Dn.box_stats(items, "agent", "friction_score"),
        "friction_histogram_by_agent": Dn.histogram(items, "agent", "friction_score"),
        "pairwise_tests": X.posthoc_pairs(items, "agent", "friction_score"),
        "friction_by_type": A.order_by_mean(A.group_summary(items, "pr_type")),
        "label_counts_by_agent": A.label_counts(items, "agent"),
        "label_counts_by_type": A.label_counts(items.where(A.known_type("pr_type")), "pr_type"),
        "friction_box_by_agent_source": Dn.box_stats(items, ["agent", "source"], "friction_score"),
        "temporal_spearman_by_agent": X.spearman_by(
            X.days_since_first(items.where(F.col("created_at").isNotNull())
                               .select("agent", "created_at", "friction_score"), "created_at", ["agent"]),
            "agent", "time_numeric", "friction_score"),
    }
    tests = {
        "kruskal_wallis_agents": X.kruskal(items, "agent", "friction_score"),
        "kruskal_wallis_categories": X.kruskal(neg, "friction_category", "friction_score"),
        "chi2_category_agent": X.chi2_independence(neg, "friction_category", "agent"),
        "pointbiserial_merged": X.point_biserial(items, "friction_score", "is_merged"),
        "spearman_time_to_merge": X.spearman(per_pr_time, "friction_score", "time_to_merge_hours"),
        "spearman_iterations": X.spearman(per_pr_iter, "friction_score", "comment_count"),
    }
    long = S.results_long(tests)
    results["statistical_tests"] = long
    results["statistical_tests_wide"] = X.tests_wide(long, list(tests))
    tables = S.write_results(results, f"{out}/data")
    S.write_summary(S.summary_lines(items, long), f"{out}/SUMMARY")

    study = Tp.topic_study(Tp.negatives(items), "clean_body", "agent", "item_id")
    if study is not None:
        S.save_model(study.model, f"{out}/topic_model")
        S.write_results({"topic_info": study.info, "topic_agent_matrix": study.matrix,
                         "top_topics_by_agent": study.top}, f"{out}/data")
    return {"facts": list(paths.values()), "tables": tables, "summary": f"{out}/SUMMARY"}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--data", required=True, help="folder with the parquet tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--domain", action="store_true", help="the folder holds the domain tables themselves")
    ap.add_argument("--baseline", default=None, help="table of human pull requests, with --domain")
    ap.add_argument("--master", default=None)
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    a = ap.parse_args(argv)
    spark = build_session(a.master, a.shuffle_partitions, app="chafe-study")
    print(run_study(spark, a.data, a.out, a.domain, a.baseline))


if __name__ == "__main__":
    main()

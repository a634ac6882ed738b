"""No caps, prefixes or driver-side lists; bad input becomes null."""

import numpy as np
import pytest

from chafe.functions.pvalues import chi2_sf, gamma_q, norm_sf, t_sf_two_sided
from chafe.operators import distributions as Dn
from chafe.operators import scoring as U
from chafe.operators import stats as X
from chafe.sources.domain import domain_items


def test_many_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 1500:04d}", float(v)) for i, v in enumerate(rng.integers(0, 40, 6000))]
    df = spark.createDataFrame(rows, "g string, v double")
    r = X.kruskal(df, "g", "v").first()
    assert r.n == 6000 and r.dof == 1499 and 0 < r.p_value <= 1


def test_pairs_of_sixty_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 60:02d}", float(v)) for i, v in enumerate(rng.integers(0, 9, 600))]
    got = {r.pair: (r.statistic, r.n_a, r.n_b) for r in X.mann_whitney_pairs(
        spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert len(got) == 60 * 59 // 2
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    for a, b in (("g00", "g01"), ("g07", "g59"), ("g30", "g31")):
        u = sum((x > y) + 0.5 * (x == y) for x in by[a] for y in by[b])
        assert got[f"{a} vs {b}"] == (u, len(by[a]), len(by[b]))


def test_posthoc_gate(spark):
    same = [(g, float(i)) for g in "abc" for i in range(10)]
    apart = [(g, float(i + 100 * k)) for k, g in enumerate("abc") for i in range(10)]
    assert X.posthoc_pairs(spark.createDataFrame(same, "g string, v double"), "g", "v").count() == 0
    assert X.posthoc_pairs(spark.createDataFrame(apart, "g string, v double"), "g", "v").count() == 3


def test_histogram_has_every_bin_for_several_keys(spark):
    df = spark.createDataFrame([("a", "x", 0.0), ("a", "x", 29.5), ("a", "y", 3.0), ("b", "x", 1.0)],
                               "g string, s string, v double")
    rows = Dn.histogram(df, ["g", "s"], "v").collect()
    assert len(rows) == 3 * 30 and sum(r.n for r in rows) == 4


def test_classifier_failure_falls_back_per_text(spark):
    def make():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return np.array([0 if "zebra" in t else -1 for t in texts], dtype=np.int32)
        return predict
    df = spark.createDataFrame([(1, "zebra"), (2, "boom security hole"), (3, "nothing"), (4, "x" * 2000 + " password")],
                               "i int, t string")
    got = {r.i: r.friction_category for r in U.classify(df, "t", make_predict_fn=make).collect()}
    assert got == {1: "Testing", 2: "Security", 3: "Other", 4: "Security"}


def test_tail_probabilities_at_extremes():
    assert gamma_q(50, 1e8) == 0.0 and chi2_sf(2e8, 100) == 0.0
    assert chi2_sf(1e9, 1e9) == pytest.approx(0.5, abs=1e-4)
    assert chi2_sf(200, 100) == pytest.approx(1.1784500721e-08, rel=1e-9)
    assert t_sf_two_sided(5.0, 1e11) == pytest.approx(2 * norm_sf(5.0), rel=1e-8)
    assert t_sf_two_sided(2.0, 100_000) == pytest.approx(t_sf_two_sided(2.0, 100_001), rel=1e-7)


def test_domain_tables_with_bad_timestamps(spark, tmp_path):
    base = str(tmp_path)
    url = "https://api.github.com/repos/o/r"
    prs = [(1, 7, "bot-x", "merged", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z", url),
           (2, 8, None, "open", "not a time", None, "never", url),
           (3, 9, "bot-x", "closed", "2024-01-01T00:00:00Z", None, "2024-01-01T00:00:20Z", url)]
    cols = "id long, number long, agent string, state string, created_at string, merged_at string, closed_at string, repo_url string"
    spark.createDataFrame(prs, cols).write.parquet(f"{base}/pull_request.parquet")
    spark.createDataFrame([(50, 70, "h", "open", "2024-01-01", None, None, url)], cols).write.parquet(f"{base}/human_pull_request.parquet")
    spark.createDataFrame([(10, "this is a bad broken thing", "ann", f"{url}/pulls/7", "oops"),
                           (11, "looks good, thanks a lot", "ann", f"{url}/pulls/8", "2024-01-01"),
                           (12, "dropped with its pull request", "ann", f"{url}/pulls/9", None),
                           (13, "a human pull request text", "bob", f"{url}/pulls/70", None)],
                          "id long, comment string, author string, pull_request_url string, created_at string") \
        .write.parquet(f"{base}/pr_review_comments.parquet")
    spark.createDataFrame([(20, 1, "a review of some length", "eve", "Bot", None), (21, 1, "another review text", "eve", "User", "x")],
                          "id long, pr_id long, body string, user string, user_type string, submitted_at string") \
        .write.parquet(f"{base}/pr_reviews.parquet")
    spark.createDataFrame([(1, "fix")], "id long, type string").write.parquet(f"{base}/pr_task_type.parquet")
    rows = {r.item_id: r for r in domain_items(spark, base, baseline="human_pull_request").collect()}
    assert set(rows) == {10, 11, 13, 21}
    assert rows[10].is_negative and rows[10].pr_type == "fix" and rows[10].item_created_at is None
    assert rows[11].agent == "Unknown_AI" and rows[11].pr_type == "unknown" and rows[11].created_at is None
    assert rows[13].agent == "Human"

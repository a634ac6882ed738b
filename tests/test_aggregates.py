import pytest
from pyspark.sql import functions as F

from chafe.operators import aggregates as A
from chafe.operators import distributions as Dn
from chafe.operators import prep as P
from chafe.sources.tables import quality_funnel


@pytest.fixture()
def items(spark):
    rows = [("a", "x", 0.1, True), ("a", "y", 0.5, False), ("b", "x", 0.9, True),
            ("b", "x", 0.3, False), ("c", "y", 0.7, True), ("c", "y", 0.2, True)]
    return spark.createDataFrame(rows, "agent string, cat string, friction_score double, is_negative boolean")


def test_matrix_totals_and_shares(items):
    m = A.count_matrix(items, "cat", "agent").collect()
    assert sum(r.n for r in m) == 6
    wide = A.count_matrix(items, "cat", "agent", values=["a", "b", "c"]).collect()
    assert sum(sum(r[1:]) for r in wide) == 6
    s = A.shares(items, "agent").collect()
    assert sum(r.pct for r in s) == pytest.approx(100.0)
    cs = A.column_share(items, "cat", "agent").collect()
    for ag in "abc":
        assert sum(r.pct for r in cs if r.agent == ag) == pytest.approx(100.0)


def test_group_summary_single_row_std_is_null(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    r = A.group_summary(df, "g", "v").first()
    assert r["count"] == 1 and r["std"] is None


def test_top_k_ties_and_zero(spark):
    rows = [("a", 3, 5), ("a", 1, 5), ("a", 2, 5), ("a", 4, 1), ("b", 1, 0), ("b", 2, 2)]
    df = spark.createDataFrame(rows, "agent string, topic int, n long")
    got = [(r.agent, r.topic) for r in A.top_k(df, "agent", "topic").orderBy("agent", "rank").collect()]
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 2)]


def test_negative_rate_overall(items):
    r = {x.agent: x for x in A.negative_rate(items, "agent").collect()}
    assert r["c"].negative_rate == 1.0 and r["a"].overall_rate == pytest.approx(4 / 6)


def test_monthly_trend_min_count(spark):
    rows = [("2024-01-05 00:00:00", "a", 0.1)] * 5 + [("2024-02-05 00:00:00", "a", 0.3)] * 4
    df = spark.createDataFrame(rows, "ts string, agent string, friction_score double") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = A.monthly_trend(df, "ts").collect()
    assert [(r.year_month, r["count"]) for r in got] == [("2024-01", 5)]


def test_union_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id long, only_a string")
    b = spark.createDataFrame([(2,)], "id long")
    got = sorted(P.combine(a, b).collect(), key=lambda r: r.id)
    assert got[1].only_a is None


def test_task_type_duplicates_multiply(spark):
    prs = spark.createDataFrame([(1,), (2,)], "id long")
    tt = spark.createDataFrame([(1, "fix", 1.0), (1, "feat", 0.5)], "id long, type string, confidence double")
    got = sorted((r.id, r.pr_type) for r in P.with_task_type(prs, tt).collect())
    assert got == [(1, "feat"), (1, "fix"), (2, "unknown")]


def test_quality_funnel_one_pass(spark):
    df = spark.range(10)
    out = quality_funnel(df, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 5)]).collect()
    assert [r.n_rows for r in out] == [10, 5, 3]


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)],
                               "g string, v double")
    h = {(r.g, r.bin): r.n for r in Dn.histogram(df, "g", "v", bins=3).collect()}
    # width 1 over [0, 3]: 0 -> bin 0, 1 -> bin 1, 3 -> last bin (closed)
    assert (h[("a", 0)], h[("a", 1)], h[("a", 2)]) == (1, 1, 1)
    assert sum(n for (g, _), n in h.items() if g == "b") == 2


def test_density_integrates_to_about_one(spark):
    import random
    rnd = random.Random(0)
    df = spark.createDataFrame([("a", rnd.gauss(0, 1)) for _ in range(500)], "g string, v double")
    pts = sorted((r.x, r.density) for r in Dn.density(df, "g", "v").collect())
    area = sum((x2 - x1) * (d1 + d2) / 2 for (x1, d1), (x2, d2) in zip(pts, pts[1:]))
    assert 0.9 < area < 1.0

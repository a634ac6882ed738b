"""Rank statistics against brute-force references on small fixtures, plus
published golden p-values."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chafe.functions import pvalues as pv
from chafe.operators import ranks as R
from chafe.operators import stats as X


def _data(seed=1, n=400, groups="abcd", levels=23):
    rnd = random.Random(seed)
    # heavy ties (few levels) and one hot group holding most rows
    return [(rnd.choice(groups) if rnd.random() < 0.5 else groups[0], float(rnd.randint(0, levels)))
            for _ in range(n)]


def test_rank_table_matches_average_ranks(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    expect = dict(zip(pdf.v, pdf.v.rank(method="average")))
    for parts in (1, 3, 7):
        rt = R.rank_table(df, "v", n_parts=parts).collect()
        assert {r.v: r.avg_rank for r in rt} == pytest.approx(expect)
        assert sum(r.t * r.avg_rank for r in rt) == pytest.approx(len(rows) * (len(rows) + 1) / 2)


def test_grouped_rank_table(spark):
    rows = _data(seed=2)
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank(method="average")
    expect = {(g, v): r for g, v, r in pdf[["g", "v", "r"]].itertuples(index=False)}
    got = {(r.g, r.v): r.avg_rank for r in R.rank_table(df, "v", by=["g"], n_parts=5).collect()}
    assert got == pytest.approx(expect)


def test_exact_quantiles(spark):
    rows = _data(seed=3)
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    got = {r.g: (r.q1, r.med, r.q3) for r in
           R.exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=["g"], names=["q1", "med", "q3"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(tuple(sub.v.quantile([0.25, 0.5, 0.75])))


def _brute_kruskal(pdf):
    r = pdf.v.rank(method="average")
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in pdf.g.unique())
    h -= 3 * (n + 1)
    t = pdf.v.value_counts()
    return h / (1 - ((t ** 3 - t).sum()) / (n ** 3 - n))


def test_kruskal(spark):
    rows = _data(seed=4)
    df = spark.createDataFrame(rows, "g string, v double")
    r = X.kruskal(df, "g", "v").first()
    h = _brute_kruskal(pd.DataFrame(rows, columns=["g", "v"]))
    assert r.statistic == pytest.approx(h, rel=1e-12)
    assert r.dof == 3 and r.p_value == pytest.approx(pv.chi2_sf(h, 3), rel=1e-12)


def test_kruskal_guard_small_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    assert X.kruskal(df, "g", "v").first().statistic is None


def test_mann_whitney_pairs(spark):
    rows = _data(seed=5)
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    out = {r.pair: r for r in X.mann_whitney_pairs(df, "g", "v").collect()}
    assert len(out) == 6
    for r in out.values():
        a = pdf[pdf.g == r.group_a].v
        b = pdf[pdf.g == r.group_b].v
        u = sum((y < x) + 0.5 * (y == x) for x in a for y in b)
        assert r.statistic == pytest.approx(u)
        # normal approximation with tie and continuity corrections
        n1, n2 = len(a), len(b)
        both = pd.concat([a, b]).value_counts()
        ties = ((both ** 3) - both).sum()
        n = n1 + n2
        sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma
        assert r.p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-9)


def test_spearman_and_invariance(spark):
    rnd = random.Random(6)
    rows = [(float(rnd.randint(0, 30)), float(rnd.randint(0, 10)) + rnd.random() * (i % 3))
            for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double")
    pdf = pd.DataFrame(rows, columns=["x", "y"])
    rho = pdf.x.rank().corr(pdf.y.rank())
    r = X.spearman(df, "x", "y").first()
    assert r.statistic == pytest.approx(rho, rel=1e-12)
    r2 = X.spearman(df.withColumn("x", F.exp(F.col("x") / 10)), "x", "y").first()
    assert r2.statistic == pytest.approx(rho, rel=1e-12)


def test_point_biserial_constant_flag_is_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.9, 0)], "x double, f int")
    assert X.point_biserial(df, "x", "f").first().statistic is None
    df2 = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.9, 1), (0.2, 0)], "x double, f int")
    r = X.point_biserial(df2, "x", "f").first()
    assert r.statistic == pytest.approx(pd.Series([0.1, .5, .9, .2]).corr(pd.Series([0, 1, 1, 0])))


def _brute_chi2(table, yates):
    n = sum(map(sum, table))
    rs = [sum(r) for r in table]
    cs = [sum(c) for c in zip(*table)]
    s = 0.0
    for i, row in enumerate(table):
        for j, o in enumerate(row):
            e = rs[i] * cs[j] / n
            d = abs(o - e)
            if yates:
                d = max(d - 0.5, 0.0)
            s += d * d / e
    return s


@pytest.mark.parametrize("table", [[[12, 5, 0], [3, 9, 7], [1, 0, 6]], [[10, 3], [2, 8]], [[0, 7], [9, 4]]])
def test_chi2(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, o in enumerate(row) for _ in range(o)]
    df = spark.createDataFrame(rows, "a string, b string")
    r = X.chi2_independence(df, "a", "b").first()
    dof = (len(table) - 1) * (len(table[0]) - 1)
    assert r.dof == dof
    assert r.statistic == pytest.approx(_brute_chi2(table, dof == 1), rel=1e-12)


GOLDEN_CHI2 = [(1011.4858057189136, 4, 1.157272681564439e-217),
               (22.076548789998256, 4, 0.00019350962830220754),
               (82.12922886872926, 16, 6.861611351255408e-11),
               (264.60052275415694, 4, 4.651119850126782e-56),
               (60.921916974458966, 16, 3.6573766149215757e-07),
               (13.520744092971952, 4, 0.008992703350503397),
               (67.00270808006181, 20, 5.576470488812904e-07)]
GOLDEN_R = [(0.12283885046490033, 3846, 2.0979202088317694e-14),
            (0.38877140570422963, 6045, 2.4798546272603916e-217),
            (0.07272370295055337, 2451, 0.00031419121574893127),
            (0.09851822162290286, 3649, 2.466516029053552e-09),
            (0.07231957212448119, 2454, 0.000336526805533573),
            (0.09886562456391977, 3655, 2.102111176677263e-09),
            (0.24907820311997111, 73, 0.03358586681697367),
            (0.2634430310679255, 121, 0.0035053650280156548)]


@pytest.mark.parametrize("stat,dof,p", GOLDEN_CHI2)
def test_chi2_golden_p(stat, dof, p):
    assert pv.chi2_sf(stat, dof) == pytest.approx(p, rel=1e-11)


@pytest.mark.parametrize("r,n,p", GOLDEN_R)
def test_correlation_golden_p(r, n, p):
    assert pv.corr_p(r, n) == pytest.approx(p, rel=1e-10)


def test_odd_dof_and_normal():
    assert pv.chi2_sf(3.5, 3) == pytest.approx(0.32076212080563893, rel=1e-12)
    assert 2 * pv.norm_sf(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert pv.t_sf_two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-9)


def test_degenerate_group_counts(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert X.mann_whitney_pairs(one, "g", "v").count() == 0
    assert X.kruskal(one, "g", "v").first().statistic is None
    empty = one.where("v < 0")
    r = X.kruskal(empty, "g", "v").first()
    assert r.n == 0 and r.statistic is None

"""Hypothesis tests as DataFrame dataflows.

Rank tests reduce the data to the distinct-value rank table of
``ranks.rank_table`` and then to one aggregate row; p-values are applied
to that row by Arrow-batched pandas UDFs.  Nothing is collected per group.
All p-values are asymptotic (``method`` column says so).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf_udf, corr_p_udf, norm_two_sided_udf
from ..session import cut_lineage, group_side, shuffle_partitions
from .ranks import rank_table, ranged

ALPHA = 0.05


def _sig(p: Column) -> Column:
    return F.coalesce(p < F.lit(ALPHA), F.lit(False))


def _d(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


# ---- X1 / X4: Kruskal-Wallis ----------------------------------------------------
def grouped_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """(value, group, w) counts, written once."""
    return cut_lineage(df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
                       .groupBy(value, by).agg(F.count(F.lit(1)).alias("w")))


def kruskal_parts(df: DataFrame, by: str, value: str) -> DataFrame:
    """One row: n, k, H (tie corrected) and the least group size.

    Groups stay row keys, so their number is not limited.  H sums the squared
    distances of the groups' mean ranks from the middle rank, which does not
    cancel at large n as the textbook difference does."""
    long = grouped_counts(df, by, value)
    rt = cut_lineage(rank_table(long, value, weight="w").select(value, "t", "avg_rank"))
    # a value has at most one row per group, so no key of this join is hot
    groups = cut_lineage(long.join(rt, value).groupBy(by)
                         .agg(F.sum("w").alias("n_g"), F.sum(_d("w") * F.col("avg_rank")).alias("r_g")))
    total = groups.agg(F.sum("n_g")).scalar()
    ties = rt.agg(F.sum(_d("t") * _d("t") * _d("t") - _d("t"))).scalar()
    n = total.cast("double")
    off = F.col("r_g") / _d("n_g") - (n + 1.0) / 2.0
    a = groups.agg(F.coalesce(F.sum("n_g"), F.lit(0)).cast("long").alias("n"), F.count(F.lit(1)).cast("int").alias("k"),
                   F.sum(_d("n_g") * off * off).alias("_s"), F.min("n_g").cast("long").alias("min_group_n"))
    m = _d("n")
    h = F.try_divide(F.try_divide(12.0 * F.col("_s"), m * (m + 1.0)),
                     F.lit(1.0) - F.try_divide(ties, m * m * m - m))
    return a.select("n", "k", h.alias("statistic"), "min_group_n")


def kruskal(df: DataFrame, by: str, value: str, test: str | None = None) -> DataFrame:
    """Kruskal-Wallis H across groups, chi-square p with k-1 dof.  The
    statistic is null unless there are >= 2 groups of >= 2 rows (P25)."""
    p = kruskal_parts(df, by, value)
    ok = (F.col("k") >= 2) & (F.col("min_group_n") >= 2)
    out = p.select(F.lit(test or f"kruskal_{by}").alias("test"), "n",
                   (F.col("k") - 1).cast("long").alias("dof"),
                   F.when(ok, F.col("statistic")).alias("statistic"))
    out = out.withColumn("p_value", chi2_sf_udf("statistic", "dof"))
    return out.withColumn("significant", _sig(F.col("p_value"))) \
        .withColumn("method", F.lit("asymptotic"))


# ---- X2 / X9: Mann-Whitney U ------------------------------------------------------
_PAIR_ROWS = 2048     # distinct values that meet a tile's groups at a time
_TILE = 256           # groups of a tile; a task multiplies the groups of two


def _pair_sums(values: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Sums over one range of values, for every pair of groups of two tiles.

    ``values``: (v, g, w) of the range; ``before``: (name, tile, o), rows of each group in
    all ranges before.  Per pair: u = sum w_a (below_b + w_b / 2) and
    m = sum w_a^2 w_b, which the tie term needs.
    """
    before = before.sort_values("name")
    names, tile = before["name"].to_numpy(), before["tile"].to_numpy()
    below = before["o"].to_numpy(float)
    k = len(names)
    u, m = np.zeros((k, k)), np.zeros((k, k))
    if len(values):
        values = values.sort_values("v", kind="stable")
        rank = (values["v"] != values["v"].shift()).cumsum().to_numpy() - 1
        group, w = np.searchsorted(names, values["g"]), values["w"].to_numpy(float)
        for a in range(0, int(rank[-1]) + 1, _PAIR_ROWS):
            at = (rank >= a) & (rank < a + _PAIR_ROWS)
            c = np.zeros((min(_PAIR_ROWS, int(rank[-1]) + 1 - a), k))
            c[rank[at] - a, group[at]] = w[at]
            up_to = below + np.cumsum(c, axis=0)
            u += c.T @ (up_to - c / 2.0)
            m += (c * c).T @ c
            below = up_to[-1]
    u[np.tril_indices(k)] = 0.0          # pairs in sorted order
    np.fill_diagonal(m, 0.0)
    if k and tile.min() != tile.max():      # pairs inside one tile have a task of their own
        same = tile[:, None] == tile[None, :]
        u[same] = m[same] = 0.0
    i, j = np.nonzero((u != 0) | (m != 0))
    return pd.DataFrame({"ga": names[i], "gb": names[j], "u": u[i, j], "m": m[i, j]})


def mann_whitney_pairs(df: DataFrame, by: str, value: str, min_n: int = 2) -> DataFrame:
    """All group pairs (sorted order), two-sided, tie and continuity corrected.

    ``U_ab = sum_v n_a(v) (n_b(< v) + n_b(v) / 2)``.  The value counts are dealt
    into ranges of values and the groups into tiles; a task multiplies the values x
    groups counts of one range and two tiles, so its matrices stay small however
    many groups there are, and only sums per pair leave it."""
    n_parts = shuffle_partitions(df.sparkSession)
    long = grouped_counts(df, by, value).select(_d(value).alias("v"), F.col(by).cast("string").alias("g"), "w")
    parts = ranged(long, ["v"], n_parts)
    w = _d("w")
    groups = cut_lineage(parts.groupBy(F.col("g").alias("name"))
                         .agg(F.sum("w").alias("n"), F.sum(w * w * w - w).alias("cubes")))
    # every group's rows in front of every range: ranges x groups rows
    sizes = parts.groupBy(F.col("_pid").alias("_at"), F.col("g").alias("_g")).agg(F.sum("w").alias("s"))
    grid = groups.select("name", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("range"))
    n_tiles = -(-groups.count() // _TILE)
    tile = F.pmod(F.xxhash64("name"), F.lit(max(1, n_tiles))).cast("int")

    def dealt(frame: DataFrame, name: str) -> DataFrame:
        """Each row once for every pair of tiles that its own tile takes part in."""
        other = F.explode(F.sequence(F.lit(0), F.lit(max(1, n_tiles) - 1)))
        return frame.withColumn("name", F.col(name)).withColumn("tile", tile).withColumn("_o", other) \
            .withColumn("_ti", F.least("tile", "_o")).withColumn("_tj", F.greatest("tile", "_o")).drop("_o")
    front = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.join(sizes, (F.col("range") == F.col("_at")) & (F.col("name") == F.col("_g")), "left") \
        .select("range", "name", F.coalesce(F.sum("s").over(front), F.lit(0)).alias("o"))
    sums = cut_lineage(dealt(parts, "g").groupBy("_pid", "_ti", "_tj").cogroup(dealt(before, "name").groupBy("range", "_ti", "_tj"))
                       .applyInPandas(_pair_sums, "ga string, gb string, u double, m double")
                       .groupBy("ga", "gb").agg(F.sum("u").alias("u"), F.sum("m").alias("m")))
    a = groups.select(F.col("name").alias("group_a"), F.col("n").alias("n_a"), F.col("cubes").alias("_ca"))
    b = groups.select(F.col("name").alias("group_b"), F.col("n").alias("n_b"), F.col("cubes").alias("_cb"))
    ab = sums.select(F.col("ga").alias("group_a"), F.col("gb").alias("group_b"), "u", F.col("m").alias("_ab"))
    ba = sums.select(F.col("gb").alias("group_a"), F.col("ga").alias("group_b"), F.col("m").alias("_ba"))
    zero = F.lit(0.0)
    pairs = a.join(b, F.col("group_a") < F.col("group_b")) \
        .join(ab, ["group_a", "group_b"], "left").join(ba, ["group_a", "group_b"], "left")
    ties = F.col("_ca") + F.col("_cb") + 3.0 * (F.coalesce("_ab", zero) + F.coalesce("_ba", zero))
    return _mw_p(pairs.select(F.concat_ws(" vs ", "group_a", "group_b").alias("pair"), "group_a", "group_b",
                              "n_a", "n_b", F.coalesce("u", zero).alias("statistic"), ties.alias("ties")), min_n)


PAIR_SCHEMA = ("pair string, group_a string, group_b string, n_a long, n_b long, statistic double, p_value double, "
               "significant boolean, method string")


def posthoc_pairs(df: DataFrame, by: str, value: str, min_n: int = 2) -> DataFrame:
    """X2 as the reference runs it: the pairs only if the omnibus test is significant;
    otherwise nothing is computed for them."""
    if kruskal(df, by, value).first()["significant"]:
        return mann_whitney_pairs(df, by, value, min_n)
    return df.sparkSession.createDataFrame([], PAIR_SCHEMA)


def _mw_p(long: DataFrame, min_n: int) -> DataFrame:
    n1, n2 = _d("n_a"), _d("n_b")
    n = n1 + n2
    u = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.col("ties") / (n * (n - 1.0))))
    z = F.try_divide(u - n1 * n2 / 2.0 - 0.5, sigma)
    ok = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    out = long.withColumn("statistic", F.when(ok, F.col("statistic"))) \
        .withColumn("p_value", F.when(ok, norm_two_sided_udf(z)))
    return out.drop("ties").withColumn("significant", _sig(F.col("p_value"))) \
        .withColumn("method", F.lit("asymptotic"))


def mann_whitney(df: DataFrame, flag: Column, value: str, a: str = "Human",
                 b: str = "AI") -> DataFrame:
    """Two-group test on a derived group (flag true -> ``a``), U of ``a``.  No row
    where one of the groups is empty."""
    g = df.withColumn("_grp", F.when(flag, F.lit(a)).otherwise(F.lit(b)))
    long = grouped_counts(g, "_grp", value)
    rt = cut_lineage(rank_table(long, value, weight="w").select(value, "t", "avg_rank"))
    # U of ``a`` from its rank sum; a value has at most two rows here
    own = F.col("_grp") == F.lit(a)
    r = long.join(rt, value).agg(
        F.coalesce(F.sum(F.when(own, F.col("w"))), F.lit(0)).cast("long").alias("n_a"),
        F.coalesce(F.sum(F.when(~own, F.col("w"))), F.lit(0)).cast("long").alias("n_b"),
        F.sum(F.when(own, _d("w") * F.col("avg_rank"))).alias("_ra"))
    ties = rt.agg(F.coalesce(F.sum(_d("t") * _d("t") * _d("t") - _d("t")), F.lit(0.0))).scalar()
    u = F.col("_ra") - _d("n_a") * (_d("n_a") + 1.0) / 2.0
    one = r.where((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        F.lit(f"{a} vs {b}").alias("pair"), F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "n_a", "n_b",
        u.alias("statistic"), ties.alias("ties"))
    return _mw_p(one, 2)


# ---- X3: point-biserial ------------------------------------------------------------
def point_biserial(df: DataFrame, x: str, flag: str, test: str = "pointbiserial") -> DataFrame:
    """Pearson r of a score against a 0/1 flag; null when either is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(flag).isNotNull())
    a = d.agg(F.count(F.lit(1)).alias("n"),
              F.covar_pop(_d(x), _d(flag)).alias("_c"),
              F.stddev_pop(_d(x)).alias("_sx"), F.stddev_pop(_d(flag)).alias("_sy"))
    r = F.try_divide(F.col("_c"), F.col("_sx") * F.col("_sy"))
    r = F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), r)
    out = a.select(F.lit(test).alias("test"), F.col("n").cast("long").alias("n"), r.alias("statistic"))
    out = out.withColumn("p_value", corr_p_udf("statistic", "n"))
    return out.withColumn("significant", _sig(F.col("p_value")))


# ---- X5: chi-square independence ----------------------------------------------------
def chi2_independence(df: DataFrame, a: str, b: str, test: str | None = None) -> DataFrame:
    """chi2 = sum (O - E)^2 / E: over observed cells, plus the E of the empty ones
    (N minus the observed cells' E), dof = (rows - 1)(cols - 1) over non-empty rows/columns.

    One aggregate over the cell table joined to its two marginals (the cell
    aggregation is computed once; Spark reuses its exchange).  Yates'
    correction applies when dof == 1: in a 2x2 table every cell has the same
    |O - E| = d, so any observed cell gives d, and sum 1/E over the four cells
    is N^3 / (r (N - r) c (N - c))."""
    # the cell table (rows x columns, small) is written once and read three times
    cells = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .groupBy(a, b).agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = _d("_total")
    e = _d("r") * _d("c") / total
    # the empty cells' E: per row, the column totals that it has no cell for
    full = cells.join(group_side(rows), a).join(group_side(cols), b).withColumn("_total", cells.agg(F.sum("o")).scalar())
    agg = full.agg(F.sum("o").alias("N"),
                   F.sum(F.pow(_d("o") - e, 2) / e).alias("_s"), F.sum(e).alias("_e"),
                   F.countDistinct(a).alias("_nr"), F.countDistinct(b).alias("_nc"),
                   F.min(F.struct(_d("o").alias("o"), _d("r").alias("r"), _d("c").alias("c"))).alias("_cell"))
    N = _d("N")
    o, r, c = F.col("_cell.o"), F.col("_cell.r"), F.col("_cell.c")
    dof = ((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("long")
    plain = F.col("_s") + F.greatest(N - F.col("_e"), F.lit(0.0))
    d = F.abs(o - r * c / N)
    yates = F.pow(F.greatest(d - 0.5, F.lit(0.0)), 2) * N * N * N / (r * (N - r) * c * (N - c))
    stat = F.when(dof == 1, yates).otherwise(plain)
    ok = (F.col("_nr") >= 2) & (F.col("_nc") >= 2)
    out = agg.select(F.lit(test or f"chi2_{a}_{b}").alias("test"),
                     F.col("N").cast("long").alias("n"), dof.alias("dof"),
                     F.when(ok, stat).alias("statistic"))
    out = out.withColumn("p_value", chi2_sf_udf("statistic", "dof"))
    return out.withColumn("significant", _sig(F.col("p_value")))


# ---- X6-X8: Spearman ------------------------------------------------------------------
def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), test: str | None = None,
             min_n: int = 10) -> DataFrame:
    """Spearman rho = Pearson r of average ranks, per ``by`` key.

    Rows are first reduced to distinct (x, y) pairs with a weight; ranks of
    x and of y come from two rank tables joined back on the value.  Ranks
    are centred on (N + 1) / 2 before the products, so sums of squares do
    not cancel catastrophically at large N."""
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    # the pair table feeds two rank tables and the join: written once
    pairs = cut_lineage(d.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w")))
    rx = rank_table(pairs, x, by=by, weight="w").select(*by, x, F.col("avg_rank").alias("rx"))
    ry = rank_table(pairs, y, by=by, weight="w").select(*by, y, F.col("avg_rank").alias("ry"))
    j = pairs.join(rx, [*by, x]).join(ry, [*by, y])
    n = pairs.groupBy(*by).agg(F.sum("w").alias("_n"))
    j = j.join(group_side(n), by) if by else j.withColumn("_n", n.scalar())
    mid = (_d("_n") + 1.0) / 2.0
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, _d("w")
    a = j.groupBy(*by).agg(F.max("_n").alias("n"), F.sum(w * dx * dy).alias("_sxy"),
                           F.sum(w * dx * dx).alias("_sxx"), F.sum(w * dy * dy).alias("_syy"))
    rho = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    rho = F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0) & (F.col("n") >= min_n), rho)
    out = a.select(*by, F.lit(test or f"spearman_{x}_{y}").alias("test"),
                   F.col("n").cast("long").alias("n"), rho.alias("statistic"))
    out = out.withColumn("p_value", corr_p_udf("statistic", "n"))
    return out.withColumn("significant", _sig(F.col("p_value")))


def days_since_first(df: DataFrame, ts: str, by: Sequence[str], out: str = "time_numeric") -> DataFrame:
    """Whole days since the group's first timestamp."""
    by = list(by)
    t = F.col(ts).try_cast("timestamp")
    # the facts are read twice (minimum, then rows): written once, as few columns as given
    df = cut_lineage(df)
    j = df.join(group_side(df.groupBy(*by).agg(F.min(t).alias("_t0"))), by)
    micros = F.unix_micros(t) - F.unix_micros("_t0")
    return j.withColumn(out, F.floor(micros / F.lit(86_400_000_000))).drop("_t0")


def spearman_by(df: DataFrame, by: str, x: str, y: str, min_n: int = 10) -> DataFrame:
    """Per-group Spearman, groups under ``min_n`` rows dropped."""
    out = spearman(df, x, y, by=[by], test=f"spearman_{x}_{y}", min_n=min_n)
    return out.where(F.col("n") >= min_n)


def temporal_trend(df: DataFrame, ts: str, by: str, value: str, min_times: int = 10) -> DataFrame:
    """X8 with its guard (P25): Spearman of whole days since the group's first row and
    ``value``, only for groups with at least ``min_times`` timestamps."""
    rows = days_since_first(df.where(F.col(ts).isNotNull()).select(by, ts, value), ts, [by])
    enough = rows.groupBy(by).agg(F.count("time_numeric").alias("_times")).where(F.col("_times") >= min_times)
    return spearman_by(rows.join(group_side(enough.select(by)), by), by, "time_numeric", value, min_n=min_times)


# ---- X10 / X11 ---------------------------------------------------------------------
TEST_COLUMNS = ["test", "n", "statistic", "p_value"]


def tests_long(*tests: DataFrame) -> DataFrame:
    """Stack one-row test results into ``test, n, statistic, p_value, significant``."""
    parts = [t.select(F.col("test"), F.col("n").cast("long").alias("n"),
                      F.col("statistic").cast("double").alias("statistic"),
                      F.col("p_value").cast("double").alias("p_value")) for t in tests]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("significant", _sig(F.col("p_value")))


def tests_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """X11: one row with ``<test>_stat`` / ``<test>_p`` columns."""
    aggs = []
    for nm in names:
        aggs += [F.max(F.when(F.col("test") == nm, F.col("statistic"))).alias(f"{nm}_stat"),
                 F.max(F.when(F.col("test") == nm, F.col("p_value"))).alias(f"{nm}_p")]
    return long.agg(*aggs)

"""Tables behind the reference's figures (D1-D3): box statistics,
per-group histograms and kernel densities.  Nothing is drawn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import group_side
from .ranks import quantiles_from_ranks, rank_table


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def box_stats(df: DataFrame, by, value: str) -> DataFrame:
    """q1, median, q3 (exact, linear), whiskers at the furthest datum
    within 1.5 IQR, and the outlier count, per group (one or more columns).

    Everything comes from the distributed distinct-value rank table (one
    row per group and value, checkpointed): no group is gathered in one
    task and the facts are scanned once."""
    by = _keys(by)
    d = df.where(F.col(value).isNotNull()).dropna(subset=by)
    rt = rank_table(d, value, by=by)
    q = quantiles_from_ranks(rt, value, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"])
    j = rt.join(group_side(q), by)
    iqr = F.col("q3") - F.col("q1")
    lo_fence = F.col("q1") - 1.5 * iqr
    hi_fence = F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return j.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(v >= lo_fence, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_fence, v)).alias("whisker_high"),
        F.sum(F.when((v < lo_fence) | (v > hi_fence), F.col("t")).otherwise(0)).cast("long")
         .alias("n_outliers"))


SKETCH_K = 400       # KLL size; the error of a rank is about 1.7 / k ** 0.9 of the rows


def quantile_sketches(df: DataFrame, by, value: str, k: int = SKETCH_K) -> DataFrame:
    """D1 at scale: a mergeable KLL quantile sketch of ``value`` for each group.

    Sketches are built map-side, so a group of any size shuffles a few kilobytes a
    task.  Sketches of parts merge (``merge_sketches``) without the rows."""
    by = _keys(by)
    return df.where(F.col(value).isNotNull()).dropna(subset=by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"),
        F.min(value).alias("least"), F.max(value).alias("most"))


def merge_sketches(parts: DataFrame, by) -> DataFrame:
    """Sketches of several parts (days, files) -> one for each group."""
    return parts.groupBy(*_keys(by)).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"),
                                         F.min("least").alias("least"), F.max("most").alias("most"))


def sketch_quantiles(sketches: DataFrame, by, qs, names) -> DataFrame:
    """Approximate quantiles of each group: values that occur, at about the asked rank."""
    got = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(n) for q, n in zip(qs, names)]
    return sketches.select(*_keys(by), "n", *got)


def box_stats_sketched(df: DataFrame, by, value: str, k: int = SKETCH_K) -> DataFrame:
    """D1 with sketched quartiles: one pass for the sketches and one for whiskers and
    outliers; columns as ``box_stats``."""
    by = _keys(by)
    q = group_side(sketch_quantiles(quantile_sketches(df, by, value, k), by, [0.25, 0.5, 0.75], ["q1", "median", "q3"]))
    iqr = F.col("q3") - F.col("q1")
    lo, hi, v = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr, F.col(value)
    return df.where(v.isNotNull()).join(q, by).groupBy(*by).agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.sum(F.when((v < lo) | (v > hi), 1).otherwise(0)).cast("long").alias("n_outliers"))


def rank_errors(df: DataFrame, by, value: str, quantiles: DataFrame, qs, names) -> DataFrame:
    """How far approximate quantiles are off, as a share of the group's rows: the distance of
    the asked rank from the ranks that the value covers (X0), 0 if it covers it."""
    by = _keys(by)
    rt = rank_table(df.where(F.col(value).isNotNull()).dropna(subset=by), value, by=by)
    out = None
    for q, name in zip(qs, names):
        at = quantiles.select(*by, "n", F.col(name).alias("_at"))
        hit = rt.join(group_side(at), by).where(F.col(value).cast("double") == F.col("_at"))
        target = F.lit(float(q)) * F.col("n")
        off = F.greatest(F.col("below_t") - target, target - (F.col("below_t") + F.col("t")), F.lit(0.0)) / F.col("n")
        part = hit.select(*by, "n", F.lit(float(q)).alias("q"), F.col("_at").alias("value"), off.alias("rank_error"))
        out = part if out is None else out.unionByName(part)
    return out


def sample_points(df: DataFrame, by, key: str, k: int, seed: int = 0) -> DataFrame:
    """For figures of many points, ``k`` rows of each group (all, if fewer): those with the
    smallest md5 of seed and ``key``.

    The choice depends on the rows alone, not on partitions or their order, and samples
    of parts merge: the k smallest of all parts are the k smallest of the whole.
    Each task keeps its own k smallest before the shuffle.  Rows with a null key go
    last; rows of equal keys are ordered by their other columns' hash."""
    by = _keys(by)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(order), F.xxhash64(*df.columns))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= k).drop("_nth")


def histogram(df: DataFrame, by, value: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over each group's own [min, max], empty ones
    included, last bin closed; a constant group uses [v - 0.5, v + 0.5]."""
    by = _keys(by)
    d = df.where(F.col(value).isNotNull()).dropna(subset=by).select(*by, value)
    rng = d.groupBy(*by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    one = F.col("_mn") == F.col("_mx")
    rng = group_side(rng.select(*by, F.when(one, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                                F.when(one, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = d.join(rng, by).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo, span = F.col("lo"), F.col("hi") - F.col("lo")
    return every.join(counts, [*by, "bin"], "left").select(
        *by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (lo + F.col("bin") * span / F.lit(float(bins))).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * span / F.lit(float(bins))).alias("bin_hi"))


DENSITY_BINS = 32      # of the bandwidth; a bin's rows enter with their first four moments
# largest error of the sum of kernels over n h: max |He4 phi| / 4! * (1 / (2 bins)) ** 4, over h
DENSITY_ERROR = 3e-9


def density(df: DataFrame, by, value: str, points: int = 100, exact: bool = False) -> DataFrame:
    """D3: Gaussian kernel density on ``points`` grid values from each
    group's min to max, Scott bandwidth ``h = std * n^(-1/5)``.

    Rows are summed up in bins of h / 32 (one map-side combined aggregate), and each bin
    adds its kernels to every grid point by a Taylor series in the rows' distance from
    the bin's centre; the result is off by at most ``DENSITY_ERROR`` / h.  Bins
    grow with n^(1/5), whatever the number of distinct values.  ``exact`` takes the
    distinct values themselves."""
    by = _keys(by)
    d = df.where(F.col(value).isNotNull()).dropna(subset=by).select(*by, F.col(value).cast("double").alias("_v"))
    st = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("sd"),
                            F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    st = group_side(st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
                    .where(F.col("h") > 0).drop("sd"))
    v, lo, h = F.col("_v"), F.col("lo"), F.col("h")
    rows = d.join(st, by)
    if exact:
        bins = rows.groupBy(*by, v.alias("_c")).agg(F.count(F.lit(1)).cast("double").alias("s0"),
                                                    *[F.lit(0.0).alias(f"s{i}") for i in (1, 2, 3)])
    else:
        width = h / F.lit(float(DENSITY_BINS))
        rows = rows.withColumn("_c", lo + (F.floor((v - lo) / width) + 0.5) * width).withColumn("_u", (v - F.col("_c")) / h)
        u = F.col("_u")
        bins = rows.groupBy(*by, "_c").agg(F.count(F.lit(1)).cast("double").alias("s0"), F.sum(u).alias("s1"),
                                           F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"))
    step = (F.col("hi") - lo) / F.lit(float(points - 1))
    grid = bins.join(st, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))) \
        .withColumn("_t", (lo + F.col("point") * step - F.col("_c")) / h)
    t = F.col("_t")
    series = F.col("s0") + t * F.col("s1") + (t * t - 1) / 2 * F.col("s2") + (t * t - 3) * t / 6 * F.col("s3")
    norm = F.max(F.col("n") * h) * F.lit(math.sqrt(2.0 * math.pi))
    return grid.groupBy(*by, "point").agg(F.max(lo + F.col("point") * step).alias("x"),
                                          (F.sum(F.exp(-0.5 * t * t) * series) / norm).alias("density"))

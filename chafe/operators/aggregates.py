"""Group summaries, counts, shares, pivots, trends and top-k.

Every operator is a declarative aggregate: partial aggregation runs map-side,
so a hot group (one agent with a third of all rows) is combined before the
shuffle.  Totals for shares are scalar subqueries over the written count table.
Matrices are long by default (both keys stay row keys, nulls included); a wide
view is made only for column values that the caller names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import friction_band, OUTCOME_BANDS
from ..session import cut_lineage


def _list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---- A1 / A7 ------------------------------------------------------------------
def group_summary(df: DataFrame, by, value: str = "friction_score",
                  names=("mean", "count", "std"), digits: int | None = None) -> DataFrame:
    """A1: mean, count and sample std of ``value`` per group (std of one row is null)."""
    m, n, s = names
    mean = F.avg(value)
    std = F.stddev_samp(value)
    if digits is not None:
        mean, std = F.round(mean, digits), F.round(std, digits)
    return (df.groupBy(*_list(by))
              .agg(mean.alias(m), F.count(value).alias(n), std.alias(s)))


def category_stats(df: DataFrame, category: str = "friction_category",
                   value: str = "friction_score") -> DataFrame:
    """Per-category mean/std/count over categorised rows, rounded to 4."""
    rows = df.where(F.col(category) != F.lit("N/A"))
    return (rows.groupBy(category)
                .agg(F.round(F.avg(value), 4).alias("mean_friction"),
                     F.round(F.stddev_samp(value), 4).alias("std_friction"),
                     F.count(value).alias("count")))


# ---- A2 / A3 / A8 -------------------------------------------------------------
def value_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    """A2: counts per non-null value, most frequent first (ties by value)."""
    out = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), F.asc(c))
    return out.limit(top) if top else out


def shares(df: DataFrame, c: str) -> DataFrame:
    """A3: count and percentage of all rows per value."""
    # the total is summed over the written count table, not a second scan
    counts = cut_lineage(df.groupBy(c).agg(F.count(F.lit(1)).alias("count")))
    return counts.withColumn("pct", F.lit(100.0) * F.col("count") / counts.agg(F.sum("count")).scalar())


def category_counts(df: DataFrame, category: str = "friction_category") -> DataFrame:
    """Categories of negative rows with their share of all negatives."""
    return shares(df.where(F.col(category) != F.lit("N/A")), category)


# ---- A4 / A5 ------------------------------------------------------------------
def _sentiment_aggs(score: str, negative: str, label: str | None = None) -> list[Column]:
    neg = F.col(negative).cast("int")
    out = [F.count(F.lit(1)).alias("n"),
           F.sum(neg).cast("long").alias("n_negative"),
           F.avg(neg.cast("double")).alias("negative_rate"),
           F.avg(score).alias("mean_friction")]
    if label is not None:
        for lab in ("neutral", "positive"):
            out.append(F.avg((F.col(label) == F.lit(lab)).cast("double")).alias(f"{lab}_rate"))
    return out


def sentiment_summary(df: DataFrame, by: str | None = None, score: str = "friction_score",
                      negative: str = "is_negative") -> DataFrame:
    """A4: n, negatives, negative rate, mean friction, per group."""
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(*_sentiment_aggs(score, negative))


def sentiment_by_source(df: DataFrame, source: str = "source", score: str = "friction_score",
                        negative: str = "is_negative", label: str = "sentiment_label") -> DataFrame:
    """A5: label shares and mean friction per source plus an 'all' row (rollup)."""
    out = df.rollup(source).agg(*_sentiment_aggs(score, negative, label),
                                F.grouping(source).alias("_g"))
    return out.withColumn(source, F.when(F.col("_g") == 1, F.lit("all"))
                          .otherwise(F.col(source))).drop("_g")


# ---- A6 -----------------------------------------------------------------------
def merge_rates(df: DataFrame, by: str = "agent", merged: str = "is_merged") -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(merged).cast("double")).alias("merge_rate"),
                              F.count(merged).alias("count"))


# ---- A9 / A11 / A16 / A17-A19 ----------------------------------------------------
def count_long(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def count_matrix(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Row x column counts.  Long (row, column, n) with null keys kept; with
    ``values`` a zero-filled wide view of those column values."""
    long = count_long(df, row, column)
    if values is None:
        return long
    return long.groupBy(row).agg(*[
        F.coalesce(F.sum(F.when(F.col(column) == F.lit(v), F.col("n"))), F.lit(0)).cast("long").alias(str(v))
        for v in values])


def mean_matrix(df: DataFrame, row: str, column: str, value: str = "friction_score",
                values: Sequence | None = None, diff: tuple | None = None) -> DataFrame:
    """Row x column means.  Long (row, column, mean, count) with null keys
    kept; with ``values`` a wide view, empty cells null.  ``diff`` adds ``a - b`` of
    two named column values (e.g. comment minus review)."""
    if values is None:
        return df.groupBy(row, column).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    out = df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == F.lit(v), F.col(value))).alias(str(v))
                                for v in values])
    if diff:
        a, b = diff
        out = out.withColumn(f"{a}_minus_{b}", F.col(str(a)) - F.col(str(b)))
    return out


def column_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share (%) of each row value within each column value (long form)."""
    counts = count_long(df, row, column)
    w = Window.partitionBy(column)
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(w))


# ---- A10 ----------------------------------------------------------------------
def monthly_trend(df: DataFrame, ts: str, by: str = "agent", value: str = "friction_score",
                  min_n: int = 5, reviews_only: bool = False) -> DataFrame:
    """A10: mean and count per (month, group), keeping cells with >= min_n rows.
    ``reviews_only`` leaves out inline comments."""
    from ..functions.text import month_of
    if reviews_only:
        df = df.where(F.col("source") == F.lit("review"))
    return (df.where(F.col(ts).isNotNull())
              .groupBy(month_of(ts).alias("year_month"), by)
              .agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
              .where(F.col("count") >= min_n))


# ---- A12 / A13 ----------------------------------------------------------------
def per_pr_time(df: DataFrame, pr: str = "id_pr", hours: str = "time_to_merge_hours",
                value: str = "friction_score", agent: str = "agent") -> DataFrame:
    """Per PR mean friction, its (PR-level) hours and agent."""
    return df.groupBy(pr).agg(F.avg(value).alias("friction_score"),
                              F.any_value(hours).alias(hours),
                              F.any_value(agent).alias(agent))


def per_pr_iterations(df: DataFrame, pr: str = "id_pr", text: str = "clean_body",
                      value: str = "friction_score", agent: str = "agent") -> DataFrame:
    """Per PR mean friction, item count and agent."""
    return df.groupBy(pr).agg(F.avg(value).alias("friction_score"),
                              F.count(text).alias("comment_count"),
                              F.any_value(agent).alias(agent))


# ---- A14 / A15 ----------------------------------------------------------------
def order_by_mean(df: DataFrame, mean: str = "mean") -> DataFrame:
    return df.orderBy(F.desc(mean))


def label_counts(df: DataFrame, by: str, label: str = "sentiment_label") -> DataFrame:
    """Label x group counts."""
    return df.groupBy(label, by).agg(F.count(F.lit(1)).alias("count"))


def known_type(c: str) -> Column:
    """Rows without a task type say nothing about types."""
    return F.col(c) != F.lit("unknown")


# ---- A20 / A21 ----------------------------------------------------------------
def negative_rate(df: DataFrame, by: str = "pr_type", negative: str = "is_negative") -> DataFrame:
    """Negative rate per group next to the overall rate."""
    neg = F.col(negative).cast("int")
    g = cut_lineage(df.where(known_type(by)).groupBy(by).agg(F.sum(neg).alias("_k"), F.count(neg).alias("_n")))
    whole = g.agg(F.sum("_k") / F.sum("_n")).scalar()
    return g.select(by, (F.col("_k") / F.col("_n")).alias("negative_rate"), whole.alias("overall_rate"))


def pr_type_stats(df: DataFrame, by: str = "pr_type", value: str = "friction_score",
                  negative: str = "is_negative") -> DataFrame:
    """Mean, std, count, negative rate per known type, rounded to 4."""
    return df.where(known_type(by)).groupBy(by).agg(
        F.round(F.avg(value), 4).alias("mean_friction"),
        F.round(F.stddev_samp(value), 4).alias("std_friction"),
        F.count(value).alias("count"),
        F.round(F.avg(F.col(negative).cast("double")), 4).alias("negative_rate"))


# ---- A22 ----------------------------------------------------------------------
def top_k(counts: DataFrame, by: str, item: str, n: str = "n", k: int = 3) -> DataFrame:
    """Top-k items per group by count, zero counts dropped, ties to the
    lowest item.  Runs on an already aggregated count table, partitioned by
    group, so no single task sees raw rows."""
    w = Window.partitionBy(by).orderBy(F.desc(n), F.asc(item))
    return (counts.where(F.col(n) > 0)
                  .withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k))


# ---- A23 ----------------------------------------------------------------------
def ordered_groups(df: DataFrame, by: str, first: Sequence[str] = ()) -> DataFrame:
    """(group, position): the distinct non-null groups in a fixed order, those of
    ``first`` as they are given (where they occur) and the others by name.

    Groups stay rows; positions come from the distributed rank table, not from a
    window over all groups in one task."""
    from .ranks import rank_table
    groups = df.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias(by)).agg(F.count(F.lit(1)).alias("_n"))
    given = F.array_position(F.array(*[F.lit(x) for x in first]).cast("array<string>"), F.col(by))
    # equal width, so that the given ones sort by their place and in front of the others
    slot = F.when(given > 0, given).otherwise(len(first) + 1)
    keyed = groups.select(by, F.concat(F.lpad(slot.cast("string"), 10, "0"), F.lit(" "), F.col(by)).alias("_order"))
    at = rank_table(keyed, "_order").select("_order", (F.col("below_t") + 1).alias("position"))
    return keyed.join(at, "_order").select(by, "position")


# ---- A24-A26 ------------------------------------------------------------------
def band_outcomes(pr: DataFrame, score: str = "friction_score", hours: str = "time_to_merge_hours",
                  items: str = "comment_count", merged: str = "is_merged",
                  cuts=OUTCOME_BANDS) -> DataFrame:
    """Per friction band: median hours, median items, merge rate, n.
    Medians are exact and distributed (no band is gathered in one task)."""
    from .ranks import exact_quantiles
    b = cut_lineage(pr.withColumn("band", friction_band(score, cuts)).where(F.col("band").isNotNull()))
    base = b.groupBy("band").agg(F.avg(F.col(merged).cast("double")).alias("merge_rate"),
                                 F.count(F.lit(1)).alias("n"))
    mh = exact_quantiles(b, hours, [0.5], by=["band"], names=["median_hours"]).drop("n")
    mi = exact_quantiles(b, items, [0.5], by=["band"], names=["median_items"]).drop("n")
    return base.join(mh, "band", "left").join(mi, "band", "left")


def quartile_contrast(pr: DataFrame, score: str = "friction_score",
                      items: str = "comment_count") -> DataFrame:
    """Top vs bottom friction quartile: median/mean items and counts.
    Cut points are exact quantiles of the score (scalar subqueries)."""
    from .ranks import exact_quantiles
    pr = cut_lineage(pr)
    q = exact_quantiles(pr, score, [0.25, 0.75], names=["lo", "hi"])
    lo, hi = q.select("lo").scalar(), q.select("hi").scalar()
    tagged = pr.withColumn("quartile",
                           F.when(F.col(score) <= lo, F.lit("bottom"))
                            .when(F.col(score) >= hi, F.lit("top"))).where(F.col("quartile").isNotNull())
    base = tagged.groupBy("quartile").agg(F.avg(items).alias("mean_items"),
                                          F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(tagged, items, [0.5], by=["quartile"], names=["median_items"]).drop("n")
    return base.join(med, "quartile", "left")


def band_counts(df: DataFrame, by: str = "agent", score: str = "friction_score") -> DataFrame:
    """low/medium/high friction counts per group."""
    band = friction_band(score)
    return df.groupBy(by).agg(*[F.count(F.when(band == F.lit(b), 1)).alias(b)
                                for b in ("low", "medium", "high")])

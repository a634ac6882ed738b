"""Distributed average ranks and exact order statistics.

``Window.orderBy(v)`` without a partition key pulls every row into one task.
Instead ranks are computed on the table of *distinct* values:

1. ``groupBy(by, v)`` with counts.  Partial aggregation runs map-side, so a value held by a third of all rows (a
   friction of exactly 0, say) collapses to one row before the shuffle.
2. ``repartitionByRange(n, by, v)`` gives each partition a contiguous value
   range.  The partition id is stored and the table is checkpointed to the
   shared checkpoint folder: the sampled boundaries and ids stay fixed if an
   executor is lost and a stage re-runs.
3. Per-partition totals (at most n + #by rows) -> running offsets with a
   window over that tiny table -> joined back (broadcast, its size checked).
4. Inside each partition a running sum over the sorted values, plus the
   partition offset, is the number of smaller values.  The average rank of a
   value with t copies is ``below + (t + 1) / 2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, group_side, shuffle_partitions


def ranged(df: DataFrame, keys: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """``df`` in contiguous key ranges, the range's number in ``_pid``; written, so
    that the sampled boundaries stay fixed when a stage runs again."""
    n = n_parts or max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None,
               n_parts: int | None = None) -> DataFrame:
    """Distinct-value rank table.

    Columns: ``by...``, ``value``, ``t`` (rows holding the value), ``below_t``
    (rows with a smaller value inside the same ``by`` key) and ``avg_rank``.
    ``weight`` names a count column when the input is already aggregated.
    """
    by = list(by)
    cnt = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(cnt.alias("t"))
    parts = ranged(counts, [*by, value], n_parts)
    totals = parts.groupBy(*by, "_pid").agg(F.sum("t").alias("_n"))
    wo = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_pid", F.coalesce(F.sum("_n").over(wo), F.lit(0)).cast("long").alias("_before"))
    # without ``by`` at most one row per range; otherwise checked
    offsets = group_side(offsets) if by else F.broadcast(offsets)
    wi = Window.partitionBy(*by, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(offsets, on=[*by, "_pid"]).select(
        *by, value, "t", (F.col("_before") + F.coalesce(F.sum("t").over(wi), F.lit(0))).cast("long").alias("below_t"))
    return out.withColumn("avg_rank",
                          F.col("below_t").cast("double") + (F.col("t").cast("double") + 1.0) / 2.0)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average rank (1-based, ties averaged) of every row's value, within
    ``by``.  Rank is attached by joining the distinct-value table back."""
    rt = rank_table(df, value, by=by).select(*by, value, F.col("avg_rank").alias(out))
    return df.join(rt, on=[*by, value], how="left")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy 'linear' / SQL
    ``percentile``) per ``by`` key, without gathering a group in one task."""
    return quantiles_from_ranks(rank_table(df, value, by=by), value, qs, by, names)


def quantiles_from_ranks(rt: DataFrame, value: str, qs: Sequence[float],
                         by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Position ``h = q (N - 1)``; the distinct value covering sorted
    positions ``[below_t, below_t + t)`` that contains floor(h) (and the one
    containing ceil(h)) is found by a filter on the rank table, then the two
    are interpolated."""
    by = list(by)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    n = rt.groupBy(*by).agg(F.sum("t").alias("_n"))
    rt = rt.join(group_side(n), on=by, how="inner") if by else rt.withColumn("_n", n.scalar())
    lo_hi = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.floor(h), F.ceil(h)
        lo_hi += [F.max(F.when((F.col("below_t") <= lo) & (lo < F.col("below_t") + F.col("t")),
                               F.col(value))).alias(f"_lo{i}"),
                  F.max(F.when((F.col("below_t") <= hi) & (hi < F.col("below_t") + F.col("t")),
                               F.col(value))).alias(f"_hi{i}"),
                  F.max(h - lo).alias(f"_fr{i}")]
    agg = rt.groupBy(*by).agg(F.max("_n").alias("n"), *lo_hi)
    cols = [F.col(b) for b in by] + [F.col("n")]
    for i, nm in enumerate(names):
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        cols.append((lo + fr * (hi - lo)).alias(nm))
    return agg.select(*cols)

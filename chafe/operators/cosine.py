"""Cosine self-join of sparse vectors above a threshold (T4).

Vectors are scaled to length 1, so a pair's cosine is its dot product.  Terms go from
the rarest to the commonest, in classes of equal document frequency.  ``tail(v, D)``
is the length of v's part in class D and all commoner ones.  Two vectors whose
first common class is D have a dot product of at most tail(a, D) * tail(b, D), so

* a vector meets others only through terms whose tail is at least the threshold
  (its prefix; the rest can't bring a pair there alone), and
* a meeting counts only if the product of the two tails reaches the threshold.

Terms that nearly all vectors hold stand last and usually are in nobody's prefix,
which is what keeps the join far below all pairs.  Candidates are then verified
exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SLACK = 1e-9        # of bounds, against the rounding of doubles


def unit_vectors(vectors: DataFrame, key: str, term: str = "term", value: str = "score") -> DataFrame:
    """(key, term, x, df): rows scaled to length 1 for each key, and the number of keys that
    hold the term.  Null keys, terms and values and zeros are left out."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(term).isNotNull() & (F.col(value) != 0)) \
        .select(F.col(key).alias("key"), F.col(term).alias("term"), F.col(value).cast("double").alias("v"))
    rows = cut_lineage(rows)
    norms = rows.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return cut_lineage(rows.join(norms, "key").join(df, "term")
                       .select("key", "term", (F.col("v") / F.col("norm")).alias("x"), "df"))


def meetings(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b, once for each term through which two vectors meet."""
    # at most as many classes for a key as there are keys
    classes = units.groupBy("key", "df").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    behind = Window.partitionBy("key").orderBy(F.desc("df"))
    tails = classes.withColumn("tail", F.sqrt(F.sum("s").over(behind))).drop("s")
    # a term of one key brings nobody together
    prefix = cut_lineage(units.where(F.col("df") > 1).join(tails, ["key", "df"])
                         .where(F.col("tail") >= threshold - SLACK).select("key", "term", "tail"))
    a = prefix.select(F.col("key").alias("a"), "term", F.col("tail").alias("tail_a"))
    b = prefix.select(F.col("key").alias("b"), "term", F.col("tail").alias("tail_b"))
    return a.join(b, "term").where((F.col("a") < F.col("b")) & (F.col("tail_a") * F.col("tail_b") >= threshold - SLACK)) \
        .select("a", "b")


def cosine_pairs(vectors: DataFrame, key: str, threshold: float, term: str = "term", value: str = "score") -> DataFrame:
    """(a, b, cosine) of all pairs of keys a < b whose vectors' cosine is at least
    ``threshold`` (above 0).  ``vectors`` has one row for each key and term."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    units = unit_vectors(vectors, key, term, value)
    pairs = cut_lineage(meetings(units, threshold).distinct())
    # the vectors meet by term and products are summed up in the same tasks: copying each
    # pair's vectors to look its terms up would shuffle pairs x terms rows
    shared = units.where(F.col("df") > 1)
    left = shared.select(F.col("key").alias("a"), "term", F.col("x").alias("xa"))
    right = shared.select(F.col("key").alias("b"), "term", F.col("x").alias("xb"))
    dots = left.join(right, "term").where(F.col("a") < F.col("b")) \
        .groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))
    return dots.join(pairs, ["a", "b"], "left_semi").where(F.col("cosine") >= threshold)

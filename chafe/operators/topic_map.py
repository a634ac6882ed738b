"""Distance outliers and lasting topic numbers.

A row far from its cluster's centre is no member of the topic: rows beyond a quantile
of their cluster's distances become the outlier topic -1.  The quantiles are exact
and come from the distributed rank table, so no cluster is gathered in one task.

``TopicMap`` is the last stage of a topic pipeline.  It holds what was fitted: the
centres, each cluster's cut, and the map from cluster to topic number.  It is
saved and loaded with the pipeline, so new texts get the fitted topics' numbers
whatever their own sizes are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, group_side
from .ranks import exact_quantiles

OUTLIER_TOPIC = -1
MIN_TOPIC_SIZE = 5
OUTLIER_QUANTILE = 0.95


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


class TopicMap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """(vector, cluster) -> (distance, topic), from fitted centres, cuts and numbers."""
    vectorCol = Param(Params._dummy(), "vectorCol", "vector column", TypeConverters.toString)
    clusterCol = Param(Params._dummy(), "clusterCol", "cluster column", TypeConverters.toString)
    topicCol = Param(Params._dummy(), "topicCol", "topic column that is added", TypeConverters.toString)
    distanceCol = Param(Params._dummy(), "distanceCol", "distance column that is added", TypeConverters.toString)
    centers = Param(Params._dummy(), "centers", "coordinates of all centres, one after the other", TypeConverters.toListFloat)
    cuts = Param(Params._dummy(), "cuts", "largest distance of a member, for each cluster", TypeConverters.toListFloat)
    topics = Param(Params._dummy(), "topics", "topic number of each cluster", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, vectorCol: str = "_pca", clusterCol: str = "_cluster", topicCol: str = "topic",
                 distanceCol: str = "topic_distance", centers: Sequence[float] = (), cuts: Sequence[float] = (),
                 topics: Sequence[int] = ()):
        super().__init__()
        self._setDefault(vectorCol="_pca", clusterCol="_cluster", topicCol="topic", distanceCol="topic_distance",
                         centers=[], cuts=[], topics=[])
        self._set(vectorCol=vectorCol, clusterCol=clusterCol, topicCol=topicCol, distanceCol=distanceCol,
                  centers=list(centers), cuts=list(cuts), topics=list(topics))

    def with_distance(self, df: DataFrame) -> DataFrame:
        k, flat = max(1, len(self.getOrDefault("topics"))), self.getOrDefault("centers")
        dims = len(flat) // k
        rows = json.dumps([flat[i * dims:(i + 1) * dims] for i in range(k)])
        center = F.try_element_at(F.from_json(F.lit(rows), "array<array<double>>"),
                                  (F.col(self.getOrDefault("clusterCol")) + 1).cast("int"))
        return df.withColumn(self.getOrDefault("distanceCol"),
                             distance(vector_to_array(F.col(self.getOrDefault("vectorCol"))), center))

    def _transform(self, df: DataFrame) -> DataFrame:
        at = (F.col(self.getOrDefault("clusterCol")) + 1).cast("int")
        cut = F.try_element_at(F.from_json(F.lit(json.dumps(self.getOrDefault("cuts"))), "array<double>"), at)
        number = F.try_element_at(F.from_json(F.lit(json.dumps(self.getOrDefault("topics"))), "array<int>"), at)
        far = F.col(self.getOrDefault("distanceCol")) > cut
        return self.with_distance(df).withColumn(
            self.getOrDefault("topicCol"),
            F.coalesce(F.when(~far, number), F.lit(OUTLIER_TOPIC)).cast("int"))


def fit_topic_map(clustered: DataFrame, centers: Sequence[Sequence[float]], vector: str = "_pca", cluster: str = "_cluster",
                  min_size: int = MIN_TOPIC_SIZE, quantile: float | None = OUTLIER_QUANTILE) -> TopicMap:
    """Cuts at the ``quantile`` of each cluster's distances (None: no cuts), and topics
    numbered by the rows within the cut, most first (ties to the lower cluster);
    clusters with fewer than ``min_size`` of them are outliers as a whole.

    The driver sees one cut and one size for each centre, which it holds already."""
    k = len(centers)
    flat = [float(x) for c in centers for x in c]
    plain = TopicMap(vectorCol=vector, clusterCol=cluster, centers=flat, cuts=[1e308] * k, topics=[0] * k)
    rows = cut_lineage(plain.with_distance(clustered).select(cluster, "topic_distance"))
    cuts = [1e308] * k
    if quantile is not None:
        for r in exact_quantiles(rows, "topic_distance", [quantile], by=[cluster], names=["cut"]).collect():
            cuts[r[cluster]] = r["cut"]
    limits = F.element_at(F.from_json(F.lit(json.dumps(cuts)), "array<double>"), (F.col(cluster) + 1).cast("int"))
    sizes = dict(rows.where(F.col("topic_distance") <= limits).groupBy(cluster).count().collect())
    topics = [OUTLIER_TOPIC] * k
    for number, c in enumerate(sorted((c for c in sizes if sizes[c] >= min_size), key=lambda c: (-sizes[c], c))):
        topics[c] = number
    return TopicMap(vectorCol=vector, clusterCol=cluster, centers=flat, cuts=cuts, topics=topics)


def distance_outliers(df: DataFrame, vector: str, by: str, quantile: float = OUTLIER_QUANTILE,
                      out: str = "is_outlier") -> DataFrame:
    """T3 for any grouping: ``df`` with the distance of each row's array ``vector`` from its
    group's mean in ``distance``, and whether it lies beyond the group's quantile.

    Rows without a group or a vector have no distance and are no outliers.  Means
    are one map-side combined aggregate, so a hot group is never gathered."""
    rows = cut_lineage(df.withColumn("_x", F.transform(F.col(vector), lambda x: x.cast("double"))))
    told = rows.where(F.col("_x").isNotNull() & F.col(by).isNotNull())
    means = group_side(told.groupBy(F.col(by).alias("_by"))
                       .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("_x")))).alias("_mean")))
    far = cut_lineage(rows.join(means, F.col(by) == F.col("_by"), "left")
                      .withColumn("distance", distance(F.col("_x"), F.col("_mean"))).drop("_x", "_mean", "_by"))
    cuts = exact_quantiles(far, "distance", [quantile], by=[by], names=["_cut"]).select(F.col(by).alias("_by"), "_cut")
    return far.join(group_side(cuts), F.col(by) == F.col("_by"), "left") \
        .withColumn(out, F.coalesce(F.col("distance") > F.col("_cut"), F.lit(False))).drop("_by", "_cut")

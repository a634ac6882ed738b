"""Text vectors from a counted vocabulary and a randomised SVD.

A text's vector is its TF-IDF row (length 1) over a counted vocabulary, projected
on the leading right singular vectors of all rows.  The vocabulary holds the terms
found in most texts, up to a stated number; every term of it has a column of its
own, so no two collide.

The singular vectors come from subspace iteration with a random start: each round
is one pass that multiplies the rows A with a matrix Z of vocabulary x (dims +
oversample), A^T (A Z), summed up in Spark by term.  Only Z, whose size the
vocabulary and the dimensions bound, is on the driver and in the tasks; rows never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table

VOCABULARY = 1 << 17       # terms kept; with 15 columns of 8 bytes 16 MB
MIN_DF = 2
OVERSAMPLE, ROUNDS = 10, 4


def _weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of one text's terms, scaled to length 1."""
    w = counts * idf[ids]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


def _row(terms, place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([i for i in map(place.get, terms if terms is not None else ()) if i is not None], np.int64)
    ids, counts = np.unique(ids, return_counts=True)
    return ids, _weights(ids, counts, idf)


class TextVectors(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Array of terms -> vector of ``dims`` doubles.  Null arrays and texts without a known
    term get the zero vector.  Saves and loads as a stage of a pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str = "terms", outputCol: str = "vector"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.terms: list[str] = []
        self.idf = np.zeros(0)
        self.axes = np.zeros((0, 0))        # vocabulary x dims
        self.singular = np.zeros(0)

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.terms, self.idf, self.axes))

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            terms, idf, axes = shared.value
            place = {t: i for i, t in enumerate(terms)}
            for s in batches:
                out = []
                for row in s:
                    ids, w = _row(row, place, idf)
                    out.append(w @ axes[ids])
                yield pd.Series(out, dtype=object)
        return df.withColumn(self.getOutputCol(), array_to_vector(project(F.col(self.getInputCol()))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextVectors):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 - name of the API
        m, spark = self.model, SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"singular": m.singular.tolist()})
        rows = pa.table({"at": pa.array(range(len(m.terms)), pa.int32()), "term": pa.array(m.terms, pa.string()),
                         "idf": pa.array(m.idf, pa.float64()),
                         "axis": pa.array(m.axes.tolist(), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def load(self, path: str) -> TextVectors:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        m = TextVectors()
        m._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(m, metadata)
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("at").toArrow()
        m.terms, m.idf = rows.column("term").to_pylist(), rows.column("idf").to_numpy()
        m.singular = np.array(metadata["singular"])
        m.axes = np.array(rows.column("axis").to_pylist()).reshape(len(m.terms), len(m.singular))
        return m


def count_vocabulary(df: DataFrame, terms: str, size: int = VOCABULARY, min_df: int = MIN_DF) -> tuple[list[str], np.ndarray]:
    """The ``size`` terms that most texts hold (ties by term) and their idf, ln((n + 1) / (df + 1))."""
    n = df.count()
    found = df.select(F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull()) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df) \
        .orderBy(F.desc("df"), F.asc("term")).limit(size).collect()      # at most ``size`` rows
    return [r.term for r in found], np.log((n + 1.0) / (np.array([r.df for r in found], np.float64) + 1.0))


def _sparse_rows(df: DataFrame, terms: str, vocabulary: list[str], idf: np.ndarray) -> DataFrame:
    """(ids, weights) of every text, written once for all rounds."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        place = {t: i for i, t in enumerate(known)}
        for b in batches:
            got = [_row(t, place, idf) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.list_(pa.int64())),
                                              pa.array([w for _, w in got], pa.list_(pa.float64()))], names=["ids", "weights"])
    return scratch_table(df.select(terms).mapInArrow(rows, "ids array<long>, weights array<double>"))


def _gram_times(rows: DataFrame, z: np.ndarray) -> np.ndarray:
    """A^T (A z) in one pass over the rows of A."""
    size, width = z.shape
    shared = rows.sparkSession.sparkContext.broadcast(z)
    names = [f"c{j}" for j in range(width)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total = shared.value, np.zeros((size, width))
        for b in batches:
            lists = b.column(0)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids, w = lists.flatten().to_numpy(), b.column(1).flatten().to_numpy()
            if not len(ids):
                continue
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            for j in range(width):
                y = np.bincount(row, weights=w * z[ids, j], minlength=len(lists))
                total[:, j] += np.bincount(ids, weights=w * y[row], minlength=size)
        at = np.flatnonzero(total.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, j]) for j in range(width))],
                                             names=["at", *names])
    sums = rows.mapInArrow(multiply, ", ".join(["at long", *(f"{c} double" for c in names)])) \
        .groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()      # at most the vocabulary's rows
    out = np.zeros((size, width))
    out[sums.column("at").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in names])
    shared.unpersist()
    return out


def leading_axes(rows: DataFrame, size: int, dims: int, oversample: int = OVERSAMPLE, rounds: int = ROUNDS,
                 seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(axes, singular values): the ``dims`` leading right singular vectors of the sparse
    rows (ids, weights) over ``size`` columns, by randomised subspace iteration."""
    if not size:        # no vocabulary: every text gets a zero
        return np.zeros((0, 1)), np.zeros(1)
    dims = min(dims, size)
    width = min(size, dims + oversample)
    z = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for i in range(rounds):
        product = _gram_times(rows, z)
        if i + 1 < rounds:
            z = np.linalg.qr(product)[0]
    # Rayleigh-Ritz: the best axes inside the last subspace
    values, turn = np.linalg.eigh(z.T @ product)
    best = np.argsort(-values)[:dims]
    axes = z @ turn[:, best]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    return axes, np.sqrt(np.maximum(values[best], 0.0))


def fit_text_vectors(df: DataFrame, terms: str, out: str = "vector", dims: int = 5, vocabulary: int = VOCABULARY,
                     min_df: int = MIN_DF, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, seed: int = 42) -> TextVectors:
    """Vocabulary and axes of all texts of ``df`` (column ``terms``: array of terms)."""
    known, idf = count_vocabulary(df, terms, vocabulary, min_df)
    rows = _sparse_rows(df, terms, known, idf)
    model = TextVectors(inputCol=terms, outputCol=out)
    model.terms, model.idf = known, idf
    model.axes, model.singular = leading_axes(rows, len(known), dims, oversample, rounds, seed)
    return model

"""Operator 8 - toxicity with an NB-scaled character n-gram linear classifier.

Features are the distinct character n-grams of the whole text (lower-cased,
white space as one blank, a blank at both ends so that n-grams see word
starts), hashed into 2^20 buckets.  Every bucket's naive Bayes log-count ratio
r = log((p + 1) / |p| / ((q + 1) / |q|)) scales the feature, and a logistic
regression is fitted on the scaled features.

The model is fitted on a bounded sample of the labelled rows (``sample_rows``,
a hash sample of ids with one row an id); counts come from two passes over that
sample in Spark and are summed up there, and only the sums and the selected
features of sampled rows reach the driver.  Scoring covers
every document in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_bucket, fresh, map_batches, small_batches, text_key, written

SIZES = (4, 5, 6)
BUCKETS = 1 << 20
SAMPLE_ROWS = 16_384      # bound of the labelled rows that the fit reads
MAX_FEATURES = 8_192      # n-grams kept: those that speak for toxicity, by the z-score of r
MIN_Z = 3.0
ROUNDS, RATE, RIDGE = 80, 0.1, 1e-3
THRESHOLD = 0.3
_FIT_TASKS = 8            # tasks over the bounded sample
_SLICE = 1 << 16          # buckets of one row of tallies


def gram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all character n-grams of a text, repeats included."""
    chars = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "replace"),
                          dtype=np.uint32)
    out = []
    for n in SIZES:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ chars[j:j + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class ToxicityModel:
    """slot: bucket -> feature number (0: none); weight: per feature, with r
    folded in (index 0 unused); bias.  ``weight`` empty: nothing was learnt."""
    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def features(self, text: str | None) -> np.ndarray:
        s = self.slot[gram_buckets(text)]
        return np.unique(s[s > 0])

    def score(self, text: str | None) -> float:
        if len(self.weight) == 0:
            return 0.0
        z = self.weight[self.features(text)].sum() + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def _fit_linear(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on the r-scaled binary features."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if len(at) else np.empty(0, np.int64)
    x, n, m = ratio[col], len(rows), len(ratio)
    w, m1, m2 = np.zeros(m), np.zeros(m), np.zeros(m)
    b = b1 = b2 = 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(at, weights=w[col] * x, minlength=n) + b
        err = 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))) - y
        g, gb = np.bincount(col, weights=err[at] * x, minlength=m) / n + RIDGE * w, float(err.mean())
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        u, v = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= RATE * (m1 / u) / (np.sqrt(m2 / v) + 1e-8)
        b -= RATE * (b1 / u) / (np.sqrt(b2 / v) + 1e-8)
    return w * ratio, b


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y): a hash sample of about ``sample_rows`` labelled training rows.

    Held-out ids (crc32 of the id as text, modulo 4, is 2) are left out.  An id
    labelled more than once counts as toxic if any label says so.  An id with
    several rows gives one, that whose text has the least hash, so the number
    of rows does not grow with the rows of an id.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_bucket("doc_id", 4) != 2)) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("__y"))
    y = y.withColumnRenamed("doc_id", "__id")
    total = y.count()
    keep = 1 << 20 if total <= sample_rows else int((1 << 20) * sample_rows / total)
    part = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < keep
    # at most about sample_rows rows of 12 bytes: safe to broadcast
    few = F.broadcast(y.where(part))
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text")).where(part) \
        .join(few, "__id").groupBy("__id", "__y").agg(F.min_by("text", text_key("text")).alias("text")) \
        .select("text", F.col("__y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    spark = docs.sparkSession
    small_batches(spark)
    sample = written(labelled_sample(docs, labels, sample_rows)).repartition(_FIT_TASKS)

    rows = np.zeros(2, np.int64)
    for r in sample.groupBy("y").count().collect():
        rows[r["y"]] = r["count"]

    def tally(batches):
        c = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c[y, np.unique(gram_buckets(t))] += 1
        if c.any():
            for at in range(0, BUCKETS, _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([c[:, at:at + _SLICE].tobytes()])],
                                                 ["at", "c"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, np.int32)
                sums[at] = sums[at] + c if at in sums else c
        for at, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([c.tobytes()])], ["at", "c"])

    slices = sample.mapInArrow(tally, "at int, c binary").repartition(_FIT_TASKS, "at").mapInArrow(add, "at int, c binary")
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in slices.collect():    # one row a slice, 8 MB together
        counts[:, r["at"]:r["at"] + _SLICE] = np.frombuffer(r["c"], np.int32).reshape(2, -1)
    none = ToxicityModel(np.zeros(BUCKETS, np.int32), np.empty(0), 0.0)
    if rows.min() == 0:
        return none
    neg, pos = counts + 1.0
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    z = ratio / np.sqrt(1.0 / pos + 1.0 / neg)
    z[counts.sum(axis=0) < 3] = 0
    top = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    top = np.sort(top[z[top] >= MIN_Z])
    slot = np.zeros(BUCKETS, np.int32)
    slot[top] = np.arange(1, len(top) + 1)
    slots = spark.sparkContext.broadcast(slot)

    def pick(b: pa.RecordBatch) -> pa.RecordBatch:
        picker = ToxicityModel(slots.value, np.empty(0), 0.0)
        return pa.RecordBatch.from_arrays(
            [pa.array([picker.features(t).astype(np.int32).tobytes() for t in b.column(0).to_pylist()], pa.binary()),
             b.column(1)], ["f", "y"])

    picked = [(np.frombuffer(r["f"], np.int32).astype(np.int64), r["y"])
              for r in map_batches(sample, pick, "f binary, y int").collect()]
    picked.sort(key=lambda p: (p[1], p[0].tobytes()))    # the same model whatever the task order
    slots.destroy()
    weight, bias = _fit_linear([f for f, _ in picked], np.array([y for _, y in picked], float),
                               np.r_[0.0, ratio[top]])
    return ToxicityModel(slot, weight, bias)


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "__score") -> DataFrame:
    """``docs`` with a score (0 to 1) in column ``out``.  Null text scores as empty; with
    nothing learnt (no labels, or one class only) every score is 0.  A text is scored whole, whatever its
    length; a column of the name ``out`` is replaced."""
    small_batches(docs.sparkSession)
    # plain arrays: a broadcast is unpickled before the task's closure is
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = ToxicityModel(*shared.value)
        return texts.map(lambda t: m.score(t), na_action=None).astype(float)
    return docs.withColumn(out, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Defined cases: null or empty text scores what the bias says; repeated rows
    each return a row; a null doc_id is scored, and held out is then false.
    """
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels, sample_rows))
    return scored.select("doc_id", F.coalesce(crc32_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                         F.col("__score").alias("score"),
                         (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored at THRESHOLD or more; all columns stay as they are."""
    out, = fresh(docs, "__score")
    scored = score_documents(docs, fit(train_docs, labels), out=out)
    return scored.where(F.col(out) < THRESHOLD).select(*docs.columns)

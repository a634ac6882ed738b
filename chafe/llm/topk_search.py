"""Operator 3 - exact top-k inner products by no-random-access aggregation.

The vectors are dealt into shards by row.  Within a shard every dimension is a list
sorted by value, read downwards for positive query components and upwards for
negative ones.  Lists are read in rounds of equal depth, shared by a block
of queries.  After a round a vector's upper bound takes the list's last read
value for every component not read yet, its lower bound the list's end value:

    upper = q+ . max(x, read down to) + q- . min(x, read up to)

so both bounds of all vectors are two matrix products over partly read lists.
A vector whose upper bound is under the k-th largest lower bound cannot qualify.
That floor comes from the first shard, which is searched before the others, and rises with
each block finished in a task; blocks are read by falling norm.  A block whose list ends or
largest norm leave a query under its floor is not read for it.  When few vectors are left, or
the lists are read through, the final scores of those are resolved exactly.  Scores
are integers, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
K = 5
QUERY_STEP = 50
SHARD_ROWS = 16_384       # vectors of a task, about 8 MB for 64 dimensions
QUERY_ROWS = 4_096        # queries of a task
BLOCK_ROWS = 4_096        # vectors whose lists are read together
BLOCK_QUERIES = 256
ROUNDS = (0.9, 0.96)      # depths at which the bounds are compared
LEFT = 0.02               # share of candidates that is worth resolving


def quantized(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 * component) as longs.  Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(x.isNotNull() & F.col(vec_id).isNotNull()).where(finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("x"))


class SortedLists:
    """The sorted lists of one block of vectors."""

    def __init__(self, rows: np.ndarray, x: np.ndarray):
        self.rows, self.x = rows, x
        self.sorted = np.sort(x, axis=0)           # per dimension, ascending
        # a little too long, so that rounding cannot cut a vector off
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) * (1 + 1e-9)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """No vector scores more: the list's end values, and the largest norm."""
        ends = np.maximum(q, 0) @ self.sorted[-1] + np.minimum(q, 0) @ self.sorted[0]
        if q.dtype != np.float64:
            return ends
        return np.minimum(ends, np.sqrt((q ** 2).sum(axis=1)) * self.norm)

    def bounds(self, q: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of all scores once every list is read to ``depth``."""
        n = len(self.rows)
        read = min(n, max(1, int(n * depth)))
        down, up = self.sorted[n - read], self.sorted[read - 1]     # the last values read
        least, most = self.sorted[0], self.sorted[-1]               # the lists' end values
        qp, qn = np.maximum(q, 0), np.minimum(q, 0)
        upper = qp @ np.maximum(self.x, down).T + qn @ np.minimum(self.x, up).T
        lower = qp @ np.where(self.x >= down, self.x, least).T + qn @ np.where(self.x <= up, self.x, most).T
        return lower, upper


def _nothing(dtype: np.dtype) -> float | int:
    """Below every score."""
    return -np.inf if dtype == np.float64 else np.iinfo(np.int64).min


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, below every score where there are fewer."""
    n = values.shape[1]
    if n < k:
        return np.full(len(values), _nothing(values.dtype), values.dtype)
    return np.partition(values, n - k, axis=1)[:, n - k]


def search_block(lists: SortedLists, query_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int,
                 depths: list | None = None):
    """[(query, rows of the block, scores)] of vectors that may be among the k best;
    ``floor``, a score that k vectors are known to reach, is raised.  ``depths``
    gets (depth, queries that stopped there)."""
    n = len(lists.rows)
    todo, out, nothing = np.flatnonzero(lists.reach(q) >= floor), [], _nothing(q.dtype)
    if depths is not None:
        depths.append((0.0, len(q) - len(todo)))
    # integers too large for exact doubles: read through, where bounds are the scores
    for depth in (*ROUNDS, 1.0) if q.dtype == np.float64 else (1.0,):
        if not len(todo):
            break
        lower, upper = lists.bounds(q[todo], depth)
        mine = query_rows[todo, None] == lists.rows[None, :]
        lower[mine] = nothing
        floor[todo] = np.maximum(floor[todo], _kth(lower, k))
        left = (upper >= floor[todo, None]) & ~mine
        done = (left.sum(axis=1) <= max(4 * k, LEFT * n)) | (depth == 1.0)
        for r in np.flatnonzero(done):
            at = np.flatnonzero(left[r])
            scores = lists.x[at] @ q[todo[r]]                       # resolved exactly
            out.append((todo[r], at, scores))
            if len(at) >= k:
                floor[todo[r]] = max(floor[todo[r]], _kth(scores[None, :], k)[0])
        todo = todo[~done]
        if depths is not None:
            depths.append((depth, int(done.sum())))
    return out


def _width(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector counts as ending in zeros."""
    rows = column.combine_chunks()
    size = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = rows.flatten().to_numpy()
    # doubles hold every sum exactly below 2^53, and their products are fast
    biggest = int(np.abs(out).max(initial=0))
    return out.astype(np.float64) if biggest * biggest * max(1, width) < 1 << 52 else out


def _near(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score): the k best of each query in each of its shards.
    ``vectors`` has a column shard, ``queries`` a column floor (null: none known)."""
    data = vectors.select("shard", "row", "vec_id", "x") \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select(_deal(blocks), "row", "vec_id", "x", "floor") \
        .toDF("q_block", "q_row", "q_id", "q_x", "q_floor") \
        .withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width = max(_width(left.column("x")), _width(right.column("q_x")))
            x, q = _matrix(left.column("x"), width), _matrix(right.column("q_x"), width)
            if x.dtype != q.dtype:
                x, q = x.astype(np.int64), q.astype(np.int64)
            row, ids = (left.column(c).to_numpy() for c in ("row", "vec_id"))
            q_row, q_id = (right.column(c).to_numpy() for c in ("q_row", "q_id"))
            known = right.column("q_floor")
            floors = np.where(known.is_null().to_numpy(), _nothing(q.dtype), known.fill_null(0).to_numpy()).astype(q.dtype)
            order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
            x, ids, row = x[order], ids[order], row[order]
            lists = [SortedLists(row[i:i + BLOCK_ROWS], x[i:i + BLOCK_ROWS]) for i in range(0, len(row), BLOCK_ROWS)]
            for a in range(0, len(q), BLOCK_QUERIES):
                qs, qr, floor = q[a:a + BLOCK_QUERIES], q_row[a:a + BLOCK_QUERIES], floors[a:a + BLOCK_QUERIES]
                parts = [[] for _ in qs]
                for b, block in enumerate(lists):
                    for r, at, score in search_block(block, qr, qs, floor, k):
                        parts[r].append((at + b * BLOCK_ROWS, score))
                for r, p in enumerate(parts):
                    if p:
                        at = np.concatenate([i for i, _ in p])
                        score = np.concatenate([s for _, s in p]).astype(np.int64)
                        best = np.lexsort((row[at], ids[at], -score))[:k]
                        at, score = at[best], score[best]
                        found.append((np.full(len(at), q_row[a + r]), np.full(len(at), q_id[a + r]), row[at], ids[at], score))
        cols = [np.concatenate(c) for c in zip(*found)] or [[]] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query", "query_id", "row", "vec_id", "score"), cols)})

    return data.groupBy("shard", "block").cogroup(asked.groupBy("q_shard", "q_block")) \
        .applyInArrow(local, "query long, query_id long, row long, vec_id long, score long")


def _deal(parts: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Both inputs have (row, vec_id, x), ``row`` a key of the row.  A query's own row is no
    candidate, every other row is one, also of the same vec_id; ties go to the smaller
    vec_id.  Defined cases: fewer than k candidates give all of them; each row of a
    repeated query id is a query; shorter vectors count as ending in zeros; a zero vector
    scores 0 everywhere; an empty table gives no rows.  Components must keep
    scores within 64 bits.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    vectors = vectors.withColumn("shard", _deal(shards))
    asked = queries.withColumn("floor", F.lit(None).cast("long"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    near = written(_near(vectors.where("shard = 0"), asked, 1, blocks, k))
    if shards > 1:
        floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")) \
            .where(F.col("n") >= k).select(F.col("query").alias("row"), F.col("least").alias("floor"))
        rest = vectors.where("shard > 0").withColumn("shard", F.col("shard") - 1)
        near = near.unionByName(_near(rest, queries.join(floors, "row", "left"), shards - 1, blocks, k))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """Rows whose vec_id is divisible by ``step`` as queries against all rows."""
    x = written(quantized(embeddings).withColumn("row", F.monotonically_increasing_id()))
    return top_k(x, x.where(F.pmod("vec_id", F.lit(step)) == 0), k)

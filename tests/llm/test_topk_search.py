"""Exact top-k search: bounds and results against brute force."""

import math
import random

import numpy as np
import pytest

from chafe.llm import topk_search as K


def brute(rows, k=5):
    """Every row whose id is a multiple of 50 against all other rows."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
         if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, w) in enumerate(x):
        if q % 50 == 0:
            scores = [(i, sum(a * b for a, b in zip(v, w))) for m, (i, v) in enumerate(x) if m != n]
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores, key=lambda p: (-p[1], p[0]))[:k])]
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    return sorted(map(tuple, K.search(df).collect()))


@pytest.mark.parametrize("sizes", [(16384, 4096, 4096, 256), (40, 2, 16, 1)])
def test_equals_brute_force(spark, sizes, monkeypatch):
    for name, v in zip(("SHARD_ROWS", "QUERY_ROWS", "BLOCK_ROWS", "BLOCK_QUERIES"), sizes):
        monkeypatch.setattr(K, name, v)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 330)]            # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, [0.1] * 12),
             (450, [0.0] * 12), (451, [0.5] * 12), (451, [0.5] * 12), (452, [0.3] * 4), (500, [])]
    assert result(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-4000, 4000)) * 1000 for _ in range(8)]) for i in range(120)]
    assert result(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0])]) == []
    assert result(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 256 * 512)]


@pytest.mark.parametrize("copies", [2, 6, 40])
@pytest.mark.parametrize("block", [4096, 16])
def test_rows_of_one_id_are_candidates_each(spark, copies, block, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(1, 140)]
    rows += [(0, [0.5] * 12), (50, [-0.5] * 12)]
    rows += [(7, [0.9] * 12)] * copies                                      # equal rows
    rows += [(9, [-0.8 - 0.001 * j] * 12) for j in range(copies)]           # different rows
    rows += [(50, [-0.4] * 12)]                                             # a query id twice
    assert result(spark, rows) == brute(rows)


def test_bounds_enclose_scores():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-50, 50, (200, 9)).astype(float), rng.integers(-50, 50, (7, 9)).astype(float)
    lists = K.SortedLists(np.arange(200), x)
    score, width = q @ x.T, None
    for depth in (0.1, 0.5, 0.9, 1.0):
        lower, upper = lists.bounds(q, depth)
        assert (lower <= score).all() and (score <= upper).all()
        gap = (upper - lower).mean()
        assert width is None or gap <= width
        width = gap
    assert width == 0


def stops(spread):
    """(depth, queries) of two blocks of 4,000 random vectors, long ones first."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (8000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.normal(0, 1, (8000, 1))))
    x = x[np.argsort(-(x ** 2).sum(axis=1), kind="stable")]
    asked = np.arange(0, 8000, 50)
    floor, depths = np.full(len(asked), -np.inf), []
    for a in range(0, 8000, 4000):
        K.search_block(K.SortedLists(np.arange(a, a + 4000), x[a:a + 4000]), asked, x[asked], floor, 5, depths)
    return len(asked), depths


@pytest.mark.parametrize("spread", [0.0, 0.3, 0.5])
def test_most_queries_stop_before_a_full_read(spread):
    n, depths = stops(spread)
    assert sum(m for depth, m in depths if depth < 1) > 0.9 * 2 * n


def test_a_block_of_short_vectors_is_not_read():
    """Lengths over two orders of magnitude: the long half is read, the short one never."""
    n, depths = stops(1.0)
    assert depths[-1] == (0.0, n)


def test_a_hot_id_is_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 50)
    rows = [(7, [0.1 * (i % 5)] * 4) for i in range(150)] + [(i, [0.01 * i] * 4) for i in range(100)]
    assert result(spark, rows) == brute(rows)

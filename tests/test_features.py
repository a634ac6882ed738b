"""Embeddings under a width contract, label similarity, sketches, samples, ordered groups."""

import hashlib
import math
import random

import numpy as np
import pytest

from chafe.functions.lexicon import CATEGORY_KEYWORDS
from chafe.operators import aggregates as A
from chafe.operators import distributions as Dn
from chafe.operators import scoring as U
from chafe.operators import stats as X

LABELS = list(CATEGORY_KEYWORDS)


# ---- T2: embeddings ----
def make_marker(width, bad=None):
    def make():
        def predict(texts):
            assert all(t is not None for t in texts)
            out = np.tile(np.arange(width, dtype=float), (len(texts), 1))
            for i, t in enumerate(texts):
                if t == bad:
                    out[i, 0] = np.inf
            return out
        return predict
    return make


ROWS = [(1, "a", [9.0, 9.0, 9.0]), (2, "b", None), (3, "c", [1.0, 2.0]), (4, "d", [1.0, None, 3.0]), (5, "e", [1.0, float("nan"), 3.0]),
        (6, None, None), (7, None, [7.0, 7.0, 7.0]), (8, "boom", []), (9, "f", [float("inf"), 0.0, 0.0])]


def test_precomputed_first_and_bad_vectors_by_rule(spark):
    df = spark.createDataFrame(ROWS, "i int, t string, given array<float>").repartition(3)
    got = {r.i: (r.v_source, r.v) for r in U.embed(df, "t", make_marker(3, "boom"), 3, out="v", precomputed="given").collect()}
    assert {i for i in got if got[i][0] == "precomputed"} == {1, 7} and got[7][1] == [7.0] * 3
    assert {i for i in got if got[i][0] == "model"} == {2, 3, 4, 5, 9} and got[3][1] == [0.0, 1.0, 2.0]
    assert got[6] == got[8] == (None, None)


def test_width_of_the_model_is_enforced(spark):
    df = spark.createDataFrame(ROWS, "i int, t string, given array<float>")
    got = U.embed(df, "t", make_marker(4), 3, out="v", precomputed="given").collect()
    assert {r.i for r in got if r.v is not None} == {1, 7}
    with pytest.raises(Exception, match="not \\("):
        U.embed(df, "t", make_marker(4), 3, strict=True).collect()
    assert U.embed(df.where("false"), "t", make_marker(3), 3).count() == 0


def test_letter_shares():
    v = U.make_letter_shares(30)()(np.array(["Aab é1", "", "123"], dtype=object))
    assert v.shape == (3, 30) and v[0, 0] == pytest.approx(2 / 3) and v[0, 1] == pytest.approx(1 / 3) and not v[1:].any()


# ---- U6: label similarity ----
def brute_label(text):
    def grams(t):
        out = {}
        for w in U._TOKEN.split(t.lower()):
            if w:
                w = f" {w} "
                for i in range(len(w) - 2):
                    out[w[i:i + 3]] = out.get(w[i:i + 3], 0) + 1
        return out
    prompts = [grams(U.LABEL_PROMPT.format(x)) for x in LABELS]
    weight = {}
    for g in set().union(*prompts):
        n = sum(g in p for p in prompts)
        if n < len(prompts):
            weight[g] = math.log(len(prompts) / n)

    def vector(gs):
        return {g: n * weight[g] for g, n in gs.items() if g in weight}
    t = vector(grams(text))
    norm = math.sqrt(sum(x * x for x in t.values()))
    if not norm:
        return None
    best, at = -1.0, None
    for j, p in enumerate(map(vector, prompts)):
        c = round(sum(x * p.get(g, 0.0) for g, x in t.items()) / math.sqrt(sum(x * x for x in p.values())) / norm, 9)
        if c > best:
            best, at = c, j
    return LABELS[at]


TEXTS = ["please document this function", "insecure handling of tokens", "the logical order is wrong", "tests are missing for this",
         "styles differ, codes too", "nothing here", "", "fix the bug, exception on null", "testing testing documentation", "42 __ é",
         "securing the tested code style", "LOGIC and Security"]


def test_label_similarity_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "i int, t string")
    labelled = U.classify(df, "t", LABELS, make_predict_fn=U.make_label_similarity(LABELS), fallback=False).collect()
    for r in labelled:
        assert r.friction_category == (brute_label(r.t or "") or "Other"), r.t
    keyword = {r.i: r.friction_category for r in U.classify(df, "t", LABELS).collect()}
    mixed = {r.i: r.friction_category for r in
             U.classify(df, "t", LABELS, make_predict_fn=U.make_label_similarity(LABELS)).collect()}
    # nearness says what the keywords can't ("logical" is no keyword of Logic alone, "codes" none at all) ...
    assert sum(keyword[i] != mixed[i] for i in keyword) >= 2
    # ... and the keyword rule decides where no label is nearer
    for i, t in enumerate(TEXTS):
        if brute_label(t) is None:
            assert mixed[i] == keyword[i]


# ---- D1: sketches ----
def test_sketched_quartiles_are_within_the_error_bound(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 2, 30_000)] + [("b", float(v)) for v in rng.integers(0, 5, 2_000)]
    rows += [("one", 3.5), ("b", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs, names = [0.01, 0.25, 0.5, 0.75, 0.99], ["a", "b", "c", "d", "e"]
    errors = Dn.rank_errors(df, "g", "v", Dn.sketch_quantiles(Dn.quantile_sketches(df, "g", "v"), "g", qs, names), qs, names).collect()
    assert len(errors) == 3 * len(qs)           # every answer is a value that occurs
    assert max(r.rank_error for r in errors) <= 2 * 1.7 / Dn.SKETCH_K ** 0.9
    one = Dn.box_stats_sketched(df, "g", "v").where("g = 'one'").first()
    assert (one.n, one.q1, one.median, one.q3, one.whisker_low, one.whisker_high, one.n_outliers) == (1, 3.5, 3.5, 3.5, 3.5, 3.5, 0)


def test_sketches_of_parts_merge(spark):
    df = spark.range(20_000).selectExpr("'g' AS g", "CAST(id AS double) AS v", "id % 4 AS day")
    parts = Dn.quantile_sketches(df, ["g", "day"], "v").drop("day")
    whole = Dn.sketch_quantiles(Dn.merge_sketches(parts, "g"), "g", [0.5], ["median"]).first()
    assert whole.n == 20_000 and abs(whole.median / 20_000 - 0.5) < 0.02
    assert Dn.box_stats_sketched(df.where("false"), "g", "v").count() == 0


# ---- D6: samples ----
def test_sample_is_exact_and_independent_of_partitions(spark):
    rows = [(g, i, random.random()) for g, n in (("a", 500), ("b", 3), ("c", 40)) for i in range(n)] + [("b", None, 0.5)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    want = set()
    for g in "abc":
        ids = [i for h, i, _ in rows if h == g and i is not None]
        ids.sort(key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())
        want |= {(g, i) for i in ids[:40]}
    want.add(("b", None))
    for parts in (1, 9):
        got = Dn.sample_points(df.repartition(parts), "g", "id", 40, seed=1).collect()
        assert {(r.g, r.id) for r in got} == want and len(got) == 40 + 4 + 40
    # the sample of samples is the sample of the whole
    halves = [Dn.sample_points(df.where(f"id % 2 = {i}"), "g", "id", 40, seed=1) for i in (0, 1)]
    again = Dn.sample_points(halves[0].unionByName(halves[1]), "g", "id", 40, seed=1)
    assert {(r.g, r.id) for r in again.collect()} == want - {("b", None)}


# ---- D3: density ----
def test_binned_density_keeps_its_error_bound(spark):
    rng = np.random.default_rng(8)
    rows = [("n", float(v)) for v in rng.normal(5, 2, 4000)] + [("t", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 1.0)] * 5 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    near = {(r.g, r.point): (r.x, r.density) for r in Dn.density(df, "g", "v").collect()}
    full = {(r.g, r.point): (r.x, r.density) for r in Dn.density(df, "g", "v", exact=True).collect()}
    assert near.keys() == full.keys() and len(near) == 200          # a constant group has no bandwidth
    for g in ("n", "t"):
        values = np.array([v for h, v in rows if h == g and v is not None])
        h = values.std(ddof=1) * len(values) ** -0.2
        for (k, point), (x, d) in full.items():
            if k == g:
                want = np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
                assert d == pytest.approx(want, rel=1e-9, abs=1e-12)
                assert abs(near[k, point][1] - d) <= Dn.DENSITY_ERROR / h


# ---- A23, A10, P25 ----
def test_ordered_groups(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("Human",), ("c",), ("a",)], "g string")
    got = {r.g: r.position for r in A.ordered_groups(df, "g", first=["Human", "nobody"]).collect()}
    assert got == {"Human": 1, "a": 2, "b": 3, "c": 4}
    assert {r.g: r.position for r in A.ordered_groups(df, "g").collect()} == {"Human": 1, "a": 2, "b": 3, "c": 4}
    assert A.ordered_groups(df.where("false"), "g").count() == 0
    many = spark.range(500).selectExpr("concat('g', lpad(CAST(id AS string), 4, '0')) AS g")
    assert [r.g for r in A.ordered_groups(many, "g").orderBy("position").collect()] == [f"g{i:04d}" for i in range(500)]


def test_trend_of_reviews_only_and_its_guard(spark):
    rows = [("a", "review", f"2024-01-{d:02d}", float(d)) for d in range(1, 13)] + [("a", "comment", "2024-01-05", 9.0)]
    rows += [("b", "review", f"2024-01-{d:02d}", 1.0 * d) for d in range(1, 10)] + [("b", "review", None, 1.0)]
    df = spark.createDataFrame(rows, "agent string, source string, ts string, friction_score double") \
        .selectExpr("agent", "source", "CAST(ts AS timestamp) AS ts", "friction_score")
    only = {r.agent: r["count"] for r in A.monthly_trend(df, "ts", reviews_only=True).collect()}
    assert only == {"a": 12, "b": 9}
    assert {r.agent: r["count"] for r in A.monthly_trend(df, "ts").collect()} == {"a": 13, "b": 9}
    trend = X.temporal_trend(df, "ts", "agent", "friction_score").collect()
    assert [r.agent for r in trend] == ["a"] and trend[0].n == 13


def test_two_groups_without_python(spark):
    rng = np.random.default_rng(4)
    rows = [(bool(i % 3), float(v)) for i, v in enumerate(rng.integers(0, 30, 400))] + [(None, 3.0), (True, None)]
    df = spark.createDataFrame(rows, "human boolean, v double")
    r = X.mann_whitney(df, df["human"], "v").first()
    a = [v for h, v in rows if h and v is not None]
    b = [v for h, v in rows if not h and v is not None]
    assert (r.n_a, r.n_b) == (len(a), len(b))
    assert r.statistic == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_pairs_over_tiles_of_groups(spark, monkeypatch):
    """More groups than a tile holds: every pair comes from exactly one pair of tiles."""
    monkeypatch.setattr(X, "_TILE", 5)
    rng = np.random.default_rng(6)
    rows = [(f"g{i % 23:02d}", float(v)) for i, v in enumerate(rng.integers(0, 12, 700))]
    got = X.mann_whitney_pairs(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert len(got) == 23 * 22 // 2 == len({r.pair for r in got})
    for r in got:
        a, b = by[r.group_a], by[r.group_b]
        assert r.statistic == sum((x > y) + 0.5 * (x == y) for x in a for y in b), r.pair
        n = len(a) + len(b)
        t = sum(c ** 3 - c for c in np.unique(a + b, return_counts=True)[1])
        sigma = math.sqrt(len(a) * len(b) / 12 * (n + 1 - t / (n * (n - 1))))
        z = (max(r.statistic, len(a) * len(b) - r.statistic) - len(a) * len(b) / 2 - 0.5) / sigma
        assert r.p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-6, abs=1e-12)


def test_shut_gate_computes_no_pairs(spark, monkeypatch):
    same = spark.createDataFrame([(g, float(i)) for g in "abc" for i in range(10)], "g string, v double")
    monkeypatch.setattr(X, "mann_whitney_pairs", lambda *a, **k: pytest.fail("the gate is shut"))
    out = X.posthoc_pairs(same, "g", "v")
    assert out.count() == 0 and out.columns == ["pair", "group_a", "group_b", "n_a", "n_b", "statistic", "p_value",
                                                "significant", "method"]


def test_broadcasts_are_bounded_in_bytes(spark):
    """Few rows of long keys are too large; many short ones are not."""
    from chafe.session import group_side, value_bytes
    long = spark.range(40).selectExpr("repeat('k', 1000000) || id AS g", "id AS n")
    short = spark.range(5000).selectExpr("CAST(id AS string) AS g", "id AS n", "array(1.0D, 2.0D) AS v")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert not hinted(group_side(long)) and hinted(group_side(short)) and not hinted(group_side(short, max_bytes=1000))
    assert long.agg({"n": "count"}).first()[0] == 40
    assert spark.createDataFrame([("é", None, b"ab")], "a string, b int, c binary").select(
        value_bytes(spark.createDataFrame([("é", None, b"ab")], "a string, b int, c binary"))).first()[0] == (2 + 16) + 8 + (2 + 16)

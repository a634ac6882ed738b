"""Topic vectors, outliers, lasting numbers and the cosine join against brute force."""

import math
import random
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel

from chafe.operators import cosine as C
from chafe.operators import topic_map as M
from chafe.operators import topics as Tp
from chafe.operators import vectors as V
from chafe.session import scratch_table
from chafe.sources.sinks import save_model

WORDS = {"tests": ["coverage", "mock", "assert", "pytest", "fixture"], "locks": ["thread", "mutex", "race", "deadlock", "atomic"],
         "style": ["indent", "naming", "lint", "braces", "spacing"]}


def texts(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[group], k=8) + rng.choices(sum(WORDS.values(), []), k=1)), group))
    return spark.createDataFrame(rows, "id int, body string, kind string")


# ---- randomised SVD ----
def dense(rows, size):
    a = np.zeros((len(rows), size))
    for r, (ids, w) in enumerate(rows):
        a[r, ids] = w
    return a


@pytest.mark.parametrize("shape,dims", [((80, 40), 5), ((30, 60), 3), ((50, 4), 5), ((6, 50), 6)])
def test_axes_reconstruct_as_well_as_a_dense_svd(spark, shape, dims):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(shape[0]):
        ids = np.sort(rng.choice(shape[1], size=rng.integers(0, min(9, shape[1]) + 1), replace=False))
        rows.append((ids.tolist(), rng.exponential(1.0, len(ids)).tolist()))
    df = spark.createDataFrame(rows, "ids array<long>, weights array<double>").repartition(5)
    axes, singular = V.leading_axes(df, shape[1], dims)
    a, keep = dense(rows, shape[1]), min(dims, shape[1])
    best = np.linalg.svd(a, compute_uv=False)
    optimum = math.sqrt((best[keep:] ** 2).sum())
    assert np.linalg.norm(a - a @ axes @ axes.T) <= 1.01 * optimum + 1e-9
    assert np.allclose(axes.T @ axes, np.eye(keep), atol=1e-8)
    assert np.allclose(singular[:keep], best[:keep], rtol=0.02, atol=1e-6)


def test_no_two_terms_share_a_column(spark):
    """3,000 terms, far more than the old 1,024 hash buckets."""
    df = spark.createDataFrame([([f"t{i}", f"t{(i + 1) % 3000}"],) for i in range(3000)], "terms array<string>")
    known, idf = V.count_vocabulary(df, "terms")
    assert len(known) == len(set(known)) == 3000 and np.allclose(idf, math.log(3001 / 3))
    assert V.count_vocabulary(df, "terms", size=10)[0] == sorted(f"t{i}" for i in range(3000))[:10]
    assert V.count_vocabulary(df, "terms", min_df=3)[0] == []


def test_vectors_of_odd_rows_and_saving(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, None), (4, []), (5, ["never"]), (6, ["a", "b", None])],
                               "i int, terms array<string>")
    model = V.fit_text_vectors(df, "terms", dims=2)
    assert model.terms == ["a", "b"]
    path = tempfile.mkdtemp(prefix="chafe-vec-", dir="/tmp") + "/m"
    model.write().overwrite().save(path)
    again = V.TextVectors.load(path)
    a, b = ({r.i: r.vector.toArray().tolist() for r in m.transform(df).collect()} for m in (model, again))
    assert a == b and a[3] == a[4] == a[5] == [0.0, 0.0] and np.linalg.norm(a[1]) == pytest.approx(1.0)
    empty = V.fit_text_vectors(df.where("i = 5"), "terms")
    assert empty.transform(df).first().vector.toArray().tolist() == [0.0]


# ---- topics ----
def test_texts_fall_into_their_topics(spark):
    df = texts(spark)
    model = Tp.fit_text_topics(df, "body", k=3, quantile=None)
    got = model.transform(df).select("kind", "topic").collect()
    by = {}
    for r in got:
        by.setdefault(r.kind, []).append(r.topic)
    tops = {k: max(set(v), key=v.count) for k, v in by.items()}
    assert sorted(tops.values()) == [0, 1, 2]
    assert sum(v.count(tops[k]) for k, v in by.items()) > 0.95 * len(got)


def test_planted_far_rows_become_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(10.0 * (i % 3), 0.1, 4)]) for i in range(300)]
    rows += [(1000 + j, [10.0 * (j % 3) + 2.5, 10.0 * (j % 3) - 2.5, 10.0 * (j % 3), 10.0 * (j % 3)]) for j in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = Tp.fit_topic_model(df, "embedding", k=3, dims=4, quantile=0.95)
    assigned = scratch_table(Tp.assign_topics(model, df))
    topic = {r.vec_id: r.topic for r in assigned.collect()}
    assert all(topic[1000 + j] == -1 for j in range(6))
    assert sum(t == -1 for t in topic.values()) < 0.08 * len(rows)
    # the share beyond the cut in each cluster, by SQL on the written assignment
    path = assigned.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    members = model.transform(Tp.with_vector(df, "embedding")).select("vec_id", "_cluster", "topic_distance", "topic").toPandas()
    con = duckdb.connect()
    con.register("members", members)
    share = con.sql(f"""SELECT _cluster, count(*) FILTER (WHERE a.topic = -1) / count(*)::DOUBLE AS share,
        count(*) FILTER (WHERE a.topic = -1) = count(*) FILTER (WHERE a.topic_distance > cut) AS same
        FROM read_parquet('{path}/*.parquet') a JOIN members USING (vec_id)
        JOIN (SELECT _cluster, quantile_cont(topic_distance, 0.95) AS cut FROM members GROUP BY 1) USING (_cluster)
        GROUP BY 1""").fetchall()
    assert len(share) == 3 and all(0.02 < s <= 0.06 and same for _, s, same in share)


def test_numbers_last_through_saving_and_other_batches(spark):
    """A second batch with other sizes keeps the fitted numbers."""
    df = texts(spark)
    model = Tp.fit_text_topics(df, "body", k=3)
    path = tempfile.mkdtemp(prefix="chafe-topics-", dir="/tmp") + "/m"
    save_model(model, path)
    loaded = PipelineModel.load(path)
    want = {r.id: r.topic for r in model.transform(df).collect()}
    for batch in ("kind = 'style'", "id < 7", "kind <> 'tests' AND id % 5 = 0"):
        got = {r.id: r.topic for r in loaded.transform(df.where(batch)).collect()}
        assert got == {i: want[i] for i in got}
    sizes = {}
    for t in want.values():
        sizes[t] = sizes.get(t, 0) + 1
    assert [sizes[t] for t in sorted(x for x in sizes if x >= 0)] == sorted((sizes[t] for t in sizes if t >= 0), reverse=True)


def test_small_clusters_are_outliers(spark):
    rows = [(i, [0.0, 0.0 + i * 1e-3]) for i in range(50)] + [(90 + i, [9.0, 9.0]) for i in range(3)]
    model = Tp.fit_topic_model(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", k=2,
                               dims=2, min_size=5, quantile=None)
    topic = {r.vec_id: r.topic for r in Tp.assign_topics(model, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(topic[90 + i] == -1 for i in range(3)) and all(topic[i] == 0 for i in range(50))


def test_distance_outliers_of_any_grouping(spark):
    rows = [("a", [0.0, float(i % 4)]) for i in range(40)] + [("a", [50.0, 0.0]), ("b", [1.0, 1.0]), ("b", None), (None, [1.0, 1.0])]
    got = M.distance_outliers(spark.createDataFrame(rows, "g string, v array<double>"), "v", "g").collect()
    assert len(got) == len(rows)
    assert [r.v for r in got if r.is_outlier and r.distance > 10] == [[50.0, 0.0]]
    assert all(not r.is_outlier and r.distance is None for r in got if r.g is None or r.v is None)
    mean = np.mean([v for g, v in rows if g == "a"], axis=0)
    for r in got:
        if r.g == "a":
            assert r.distance == pytest.approx(np.linalg.norm(np.array(r.v) - mean))


# ---- cosine join ----
def brute_pairs(vectors, threshold):
    out = {}
    keys = sorted(vectors)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            dot = sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())
            norm = math.sqrt(sum(x * x for x in vectors[a].values()) * sum(x * x for x in vectors[b].values()))
            if norm and dot / norm >= threshold:
                out[a, b] = dot / norm
    return out


@pytest.mark.parametrize("seed,threshold", [(0, 0.9), (1, 0.5), (2, 0.2), (3, 0.7)])
def test_cosine_join_equals_brute_force(spark, seed, threshold):
    rng = random.Random(seed)
    base = [{f"t{rng.randrange(60)}": rng.random() for _ in range(12)} for _ in range(8)]
    vectors = {}
    for k in range(60):
        v = {t: x * rng.uniform(0.7, 1.3) for t, x in rng.choice(base).items() if rng.random() < 0.9}
        v["all"] = rng.random() * 0.5
        vectors[k] = v
    rows = [(k, t, x) for k, v in vectors.items() for t, x in v.items()] + [(None, "t1", 1.0), (3, None, 1.0), (3, "zero", 0.0)]
    df = spark.createDataFrame(rows, "topic int, term string, score double")
    got = {(r.a, r.b): r.cosine for r in C.cosine_pairs(df, "topic", threshold).collect()}
    want = brute_pairs(vectors, threshold)
    assert got.keys() == want.keys() and len(want) > 3
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_a_term_in_every_topic_costs_no_pairs(spark):
    """400 topics share some common terms: k * k / 2 meetings for each before, now few."""
    rng = random.Random(4)
    rows = []
    for k in range(400):
        rows += [(k, f"common{j}", rng.uniform(0.1, 0.2)) for j in range(5)]
        rows += [(k, f"own{(k // 2) * 7 + j}", rng.uniform(0.8, 1.0)) for j in range(6)]
    df = spark.createDataFrame(rows, "topic int, term string, score double")
    met = C.meetings(C.unit_vectors(df, "topic"), 0.8).count()
    everyone = 400 * 399 // 2
    assert met < 0.03 * everyone
    pairs = C.cosine_pairs(df, "topic", 0.8).collect()
    vectors = {}
    for k, t, x in rows:
        vectors.setdefault(k, {})[t] = x
    assert {(r.a, r.b) for r in pairs} == set(brute_pairs(vectors, 0.8)) and len(pairs) >= 150


def test_merge_follows_chains(spark):
    rows = [(k, t, x) for k, v in {1: {"a": 1.0, "b": 0.1}, 2: {"a": 1.0, "b": 0.4}, 3: {"a": 1.0, "b": 0.8}, 7: {"z": 1.0}}.items()
            for t, x in v.items()]
    got = {r.topic: r.merged_topic for r in Tp.merge_topics(spark.createDataFrame(rows, "topic int, term string, score double"), "topic").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7}
    with pytest.raises(ValueError):
        C.cosine_pairs(spark.createDataFrame(rows, "topic int, term string, score double"), "topic", 0.0)

"""What texts come from is worked out once, however often an operator reads them."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chafe.operators import scoring as U
from chafe.operators import topics as Tp

WORDS = {"tests": ["coverage", "mock", "assert", "pytest"], "locks": ["thread", "mutex", "race", "deadlock"],
         "style": ["indent", "naming", "lint", "braces"]}


def counted_texts(spark, n=120):
    """Texts whose rows are counted whenever they are worked out."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS[g], k=6)), g) for i in range(n) for g in [sorted(WORDS)[i % 3]]]
    seen = spark.sparkContext.accumulator(0)

    def touch(t):
        seen.add(1)
        return t
    df = spark.createDataFrame(rows, "doc_id long, raw string, kind string")
    return df.select("doc_id", "kind", F.udf(touch, "string")("raw").alias("body")), seen


def test_a_study_works_its_rows_out_once(spark):
    df, seen = counted_texts(spark)
    study = Tp.topic_study(df, "body", "kind", "doc_id", k=3)
    assert study.top.count() > 0 and study.assigned.count() == 120
    assert seen.value == 120


def test_the_fit_sends_arrays_from_few_tasks(spark):
    """60 partitions: every pass of the IDF and the regression ran in 60 tasks before."""
    df, seen = counted_texts(spark)
    df = df.withColumn("label", (F.col("kind") == "locks").cast("int")).repartition(60)
    sc = spark.sparkContext
    sc.setJobGroup("fit-scorer", "")
    model = U.fit_scorer(df, "body", "label", num_features=1 << 10, max_iter=5)
    sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("fit-scorer") for s in tracker.getJobInfo(j).stageIds}
    wide = [s for s in stages if tracker.getStageInfo(s).numTasks >= 60]
    assert len(stages) > 5 and len(wide) <= 1 and seen.value == 120
    got = U.apply_scorer(model, df).where(F.col("is_negative") == (F.col("label") == 1)).count()
    assert got == 120


def brute_counts(rows, min_df):
    n = Counter()
    for topic, text in rows:
        tok = [w for w in re.split(r"[^\w]+", (text or "").lower()) if len(w) >= 2 and w not in Tp.STOP_WORDS]
        n.update((topic, t) for t in tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])])
    df, f = Counter(t for _, t in n), Counter()
    for (_, t), k in n.items():
        f[t] += k
    return {(topic, t, k, f[t]) for (topic, t), k in n.items() if df[t] >= min_df}


@pytest.mark.parametrize("held,batch,min_df", [(1 << 21, 10000, 2), (7, 3, 1), (1, 1, 2)])
def test_counts_of_odd_rows_in_one_shuffle(spark, monkeypatch, held, batch, min_df):
    rng = random.Random(6)
    words = ["alpha", "beta", "Beta", "the", "x", "gamma", "\u00e9t\u00e9", "a_1"]
    rows = [(rng.choice(["p", "q", "r", None]), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(60)]
    rows += [("p", None), ("q", ""), ("r", "alpha"), (None, "the x")] + [("q", "hot hot hot")] * 20
    monkeypatch.setattr(Tp, "HELD_TERMS", held, raising=False)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        sc = spark.sparkContext
        sc.setJobGroup(f"counts-{held}", "")
        got = Tp.term_counts(spark.createDataFrame(rows, "topic string, body string").repartition(3), "body", "topic", min_df)
        sc._jsc.clearJobGroup()
        assert Counter(map(tuple, got.select("topic", "term", "n", "f").collect())) == Counter(brute_counts(rows, min_df))
        tracker = sc.statusTracker()
        ran = {s for j in tracker.getJobIdsForGroup(f"counts-{held}") for s in tracker.getJobInfo(j).stageIds
               if tracker.getStageInfo(s).numCompletedTasks}
        assert len(ran) == 3      # the test's own repartition, the counts, their sums
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_topic_info_works_its_texts_out_once(spark):
    df, seen = counted_texts(spark)
    got = {r["kind"]: r for r in Tp.topic_info(df, "body", "kind", "doc_id", k=4, n_docs=2, min_df=1).collect()}
    assert seen.value == 120 and {k: r["count"] for k, r in got.items()} == {g: 40 for g in WORDS}
    rows = {r["doc_id"]: r for r in df.collect()}
    for kind, r in got.items():
        top = set(r["representation"].split(", "))
        held = {}
        for i, x in rows.items():
            if x["kind"] == kind:
                tok = x["body"].split()
                held[i] = len(top & {*tok, *(f"{a} {b}" for a, b in zip(tok, tok[1:]))})
        best = sorted((i for i in held if held[i]), key=lambda i: (-held[i], i))[:2]
        assert len(top) == 4 and r["representative_docs"] == ", ".join(map(str, best))

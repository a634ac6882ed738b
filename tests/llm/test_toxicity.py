"""Toxicity: held-out accuracy and defined cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from chafe.llm import toxicity as X


def planted(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeghlnorst", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for d in range(n):
        w = rng.choices(words, k=rng.randint(20, 120))
        toxic = d % 6 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            w.insert(rng.randrange(len(w)), "vex" + rng.choice(words))
        docs.append((d, " ".join(w), "en", 0.5))
        labels.append((d, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = planted()
    extra = [(None, "lost id", "en", 0.1), (5000, None, "en", 0.1), (5001, "", "en", 0.1), (0, docs[0][1], "en", 0.2)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double")
    y = spark.createDataFrame(labels + [(None, 1, 1), (77, 0, None)], "doc_id long, quality int, toxic int")
    rows = X.classify(d, y).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = planted(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")

    def scores(y):
        return sorted((r.doc_id, r.score) for r in X.classify(
            d, spark.createDataFrame(y, "doc_id long, quality int, toxic int")).collect())
    assert scores(labels) == scores(flipped)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in X.classify(d, y).collect()] == [0.0, 0.0]
    assert X.classify(d.where("false"), y).count() == 0


def brute_grams(text):
    """Distinct n-gram buckets, one character at a time."""
    chars, out = [ord(c) for c in f" {' '.join((text or '').lower().split())} "], set()
    for n in X.SIZES:
        for i in range(len(chars) - n + 1):
            h = n
            for c in chars[i:i + n]:
                h = (h ^ c) * 0x01000193 % (1 << 32)
            h = (h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)
            out.add((h ^ h >> 12) % X.BUCKETS)
    return out


def brute_scores(docs, labels):
    """Ratios counted gram by gram, and a dense logistic regression on the scaled features."""
    truth = {i: t for i, _, t in labels}
    learn = [(brute_grams(t), truth[i]) for i, t, *_ in docs if i in truth and zlib.crc32(str(i).encode()) % 4 != 2]
    seen = [Counter(), Counter()]
    for grams, y in learn:
        seen[y].update(grams)
    size = [X.BUCKETS + sum(c.values()) for c in seen]
    chosen = {}
    for g in seen[0].keys() | seen[1].keys():
        neg, pos = seen[0][g] + 1, seen[1][g] + 1
        ratio = math.log(pos / size[1]) - math.log(neg / size[0])
        if neg + pos - 2 >= 3 and ratio / math.sqrt(1 / pos + 1 / neg) >= X.MIN_Z:
            chosen[g] = ratio
    assert 5 < len(chosen) <= X.MAX_FEATURES
    grams = sorted(chosen)
    x = np.array([[chosen[g] * (g in have) for g in grams] for have, _ in learn])
    y = np.array([t for _, t in learn], float)
    w, b = np.zeros(len(grams)), 0.0
    m, v = np.zeros(len(grams) + 1), np.zeros(len(grams) + 1)
    for t in range(1, X.ROUNDS + 1):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.r_[x.T @ err / len(y) + X.RIDGE * w, err.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = X.RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {i: 1 / (1 + math.exp(-(sum(w[k] * chosen[g] for k, g in enumerate(grams) if g in have) + b)))
            for i, have in ((i, brute_grams(t)) for i, t, *_ in docs)}


def test_ratios_and_scores_equal_brute_force(spark):
    docs, labels = planted(900, seed=3)
    long = (6000, "vexing words of a very long text " * 5000, "en", 0.0)
    docs = docs + [long, (6001, "", "en", 0.0), (6002, "v", "en", 0.0)]
    want = brute_scores(docs, labels)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in X.classify(d, y).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_rows_of_one_id_do_not_enlarge_the_sample(spark):
    docs, labels = planted(300)
    hot = next(i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, t) for i, t, *_ in docs] + [(hot, f"another text {k}") for k in range(500)] + [(hot, None)] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = X.labelled_sample(d, y).collect()
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in labels)
    assert {(r.text, r.y) for r in sample} == {(r.text, r.y) for r in X.labelled_sample(d.repartition(7), y).collect()}


def test_clashing_names_and_long_texts(spark):
    docs, labels = planted(300)
    long = "quiet words " * 60_000
    rows = [(i, t, "mine", "kept") for i, t, *_ in docs] + [(9000, long, "mine", "kept")]
    d = spark.createDataFrame(rows, "doc_id long, text string, __score string, y string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = X.drop_toxic(d, d, y)
    assert kept.columns == d.columns
    got = kept.collect()
    assert 200 < len(got) < 300 and all(r["__score"] == "mine" and r.y == "kept" for r in got)
    scores = X.score_documents(d, X.fit(d, y), out="toxicity").where("doc_id = 9000").collect()
    assert len(scores) == 1 and 0 <= scores[0].toxicity <= 1

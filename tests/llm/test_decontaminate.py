"""Benchmark decontamination against a brute-force version."""

import random

import pytest

from chafe.llm import decontaminate as D
from chafe.llm.queries import op4_benchmark_decontamination

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    """Every window of an item's size, by the exact similarity alone."""
    out = {}
    for d, t in docs:
        w = D.words_of((t or "").encode())
        for i, it in items:
            x = D.words_of((it or "").encode())
            if not x:
                continue
            best = max((D.weighted_similarity(w[s:s + len(x)], x) for s in range(len(w) - len(x) + 1)), default=0.0)
            if best >= D.MIN_SIMILARITY:
                out[d, i] = max(best, out.get((d, i), 0.0))
    return out


def brute_short(docs, items):
    """brute(), and whole documents against the items that are longer."""
    out = brute(docs, items)
    for d, t in docs:
        w = D.words_of((t or "").encode())
        for i, it in items:
            x = D.words_of((it or "").encode())
            near = D.weighted_similarity(w, x)
            if len(w) < len(x) and near >= D.MIN_SIMILARITY:
                out[d, i] = max(near, out.get((d, i), 0.0))
    return out


def result(spark, docs, items):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, window string, size int")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, fp int")
    return {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, b).collect()}


def test_planted_passages_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 20, 31, 45])))) for i in range(12)]
    items += [(50, items[2][1]), (51, None), (52, " \t"), (53, "solo"), (54, " ".join(["tick tock"] * 12))]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=rng.choice([0, 4, 60, 200]))
        if d % 3 == 0:
            p = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in p]
        docs.append((d, " ".join(w)))
    docs += [(60, None), (61, ""), (62, "solo"), (63, "tick tock " * 30), (None, items[0][1]), (5, items[1][1])]
    got = result(spark, docs, items)
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 5, 6, 9, 10, 14, 16, 24, 40, 59])]
    docs = []
    for _, t in items:
        w = t.split()
        for cut in range(len(w) // 4 + 2):
            for a in {0, cut // 2, cut}:
                docs.append((len(docs), " ".join(w[a:len(w) - cut + a])))
                docs.append((len(docs), " ".join(["changed", *w[a + 1:len(w) - cut + a]])))
    want = brute_short(docs, items)
    got = result(spark, docs, items)
    assert set(got) == set(want) and len(want) > len(brute(docs, items)) + 50
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_given_tables_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if len(t) < 6000]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    ids = {d for d, _ in docs}
    assert {k for k in got if k[0] in ids} == set(brute(docs, items))


def test_rows_of_null_or_repeated_ids_are_judged_alone(spark, tmp_path):
    rng = random.Random(17)
    a, b, clean = (" ".join(f"{c}{rng.randrange(400)}" for _ in range(20)) for c in "abc")
    rows = [(None, a), (None, clean), (None, None), (4, a), (4, clean), (4, b), (5, clean), (6, a + " " + b), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, a), (None, b), (None, "another text of no id at all"), (1, "x y z x y z")],
                                  "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, clean), (None, None), (4, clean), (5, clean)], key=repr)
    got = sorted(((r.doc_id, r.contaminated, r.item_ids) for r in op4_benchmark_decontamination(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, True, [1]), (None, False, []), (None, False, []), (4, True, [1]), (4, False, []), (4, True, [None]),
                          (5, False, []), (6, True, [1, None]), (7, True, [None])], key=repr)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b c d e f")]) == {}
    assert result(spark, [(1, "a b c d e f")], []) == {}


def test_blocks_cover_the_radius():
    """Any two fingerprints within MAX_BITS agree in a block up to BLOCK_RADIUS bits."""
    rng = random.Random(2)
    near = set(D._near_block_values())
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, D.MAX_BITS)))
        assert any(x >> 8 * j & 255 in near for j in range(8))


def test_block_join_emits_few_of_all_pairs(spark):
    rng = random.Random(11)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    windows = [(20, signed(rng.getrandbits(64)), str(i)) for i in range(600)]
    items = [(i, 20, signed(rng.getrandbits(64))) for i in range(200)]
    near = [(20, signed((items[i][2] & (1 << 64) - 1) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, D.MAX_BITS)))),
             f"near {i}") for i in range(200)]
    w = spark.createDataFrame(windows + near, "size int, fp long, window string")
    got = {(r.window, r.item) for r in D.block_pairs(w, spark.createDataFrame(items, "item long, size int, fp long")).collect()}
    assert {(f"near {i}", i) for i in range(200)} <= got
    assert len(got) < 0.05 * len(items) * (len(windows) + len(near))


def test_recall_at_the_threshold():
    """Pairs of 60-word windows whose similarity lies just over 0.8."""
    rng, cache, near = random.Random(12), D._WordHashes(), set(D._near_block_values())
    met = pairs = 0
    while pairs < 1500:
        a = [b"w%d" % rng.randrange(10_000) for _ in range(60)]
        b = a.copy()
        cut = rng.randint(1, 2)
        for _ in range(cut):
            b[rng.randrange(60)] = b"changed"
        if not 0.8 <= D.weighted_similarity(a, b) <= 0.86:
            continue
        x = (D.simhash(D.shingle_hashes(a, 5, cache)) ^ D.simhash(D.shingle_hashes(b, 5, cache))) & (1 << 64) - 1
        met += any(x >> D.BLOCK_BITS * j & (1 << D.BLOCK_BITS) - 1 in near for j in range(D.BLOCKS))
        pairs += 1
    assert met / pairs > 0.98

"""The conversation trie against a plain trie in Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chafe.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(convs):
    """{conv_id: [(key, weight), ...]} -> one row for each node."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        below = [p for p in nodes if p[:len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
                    sum(not any(q[:-1] == p for q in nodes if q) for p in below),
                    sum((len(nodes[p]) - 1) * p[-1][1] for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def key_of(name):
    return hashlib.md5(name.encode()).digest()


def seqs_of(spark, convs):
    rows = [(c, [bytearray(key_of(k)) for k, _ in turns], [w for _, w in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, seq array<binary>, weights array<long>")


def random_convs(rng, n, letters="ab", longest=5, copies=0.0):
    convs = {}
    for c in rng.sample(range(-n, 10 * n), n):
        if convs and rng.random() < copies:
            convs[c] = list(rng.choice([[], *list(convs.values())[:3]]))
        else:
            convs[c] = [(x, ord(x) % 7) for x in rng.choices(letters, k=rng.randint(0, longest))]
    return convs


@pytest.mark.parametrize("seed", range(6))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    """With few rows a shard, so that nodes, runs of copies and leaves span many shards."""
    rng = random.Random(seed)
    monkeypatch.setattr(T, "END_IDS", rng.choice([1, 3, 4096]))
    convs = random_convs(rng, rng.choice([1, 30, 120]), rng.choice(["a", "ab", "abc"]), rng.choice([2, 7]), rng.choice([0, .5]))
    spark.conf.set("spark.sql.shuffle.partitions", str(rng.choice([1, 4, 40])))
    try:
        got = T.prefix_trie(seqs_of(spark, convs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=str) == brute_trie(convs)


def test_a_third_of_copies_spans_shards(spark):
    convs = {c: [("x", 3), ("y", 4)] for c in range(400)} | {1000 + c: [("x", 3), (f"z{c}", 5)] for c in range(300)}
    convs |= {5000: [], 5001: [], 6000: [("x", 3)]}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = T.prefix_trie(seqs_of(spark, convs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=str) == brute_trie(convs)


def test_only_conversations_without_turns(spark):
    got = [tuple(r) for r in T.prefix_trie(seqs_of(spark, {3: [], 7: []})).collect()]
    assert got == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
    assert T.prefix_trie(seqs_of(spark, {}).where("false")).count() == 0


def test_long_conversations(spark):
    """2,000 turns deep; the trie's depth costs no rounds."""
    base = [(f"t{i}", i % 5) for i in range(2000)]
    convs = {1: base, 2: base[:1500] + [("other", 9)], 3: base}
    got = {(r.conv_id, r.depth): r for r in T.prefix_trie(seqs_of(spark, convs)).collect()}
    assert len(got) == 2002 and got[(1, 2000)].n_convs == 2 and got[(1, 1500)].n_children == 2
    assert got[(1, 0)].saved_tokens == 2 * sum(w for _, w in base[:1500]) + sum(w for _, w in base[1500:])
    assert got[(1, 0)].n_leaves == 2 and got[(2, 1501)].parent_conv_id == 1


def test_extents_equal_linear_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 64, 100):
        lcp = rng.integers(0, 4, n)
        table = T.SparseTable(lcp)
        rows = np.repeat(np.arange(n), 4)
        depths = np.tile(np.arange(1, 5), n)
        left, right = T.extents(table, rows, depths)
        for r, d, lo, hi in zip(rows, depths, left, right):
            want = int(r)
            while want > 0 and lcp[want] >= d:
                want -= 1
            assert lo == want
            want = int(r)
            while want + 1 < n and lcp[want + 1] >= d:
                want += 1
            assert hi == want
        lo, hi = np.minimum(rows, rows[::-1]), np.maximum(rows, rows[::-1])
        assert table.least(lo, hi).tolist() == [min(lcp[a:b + 1]) for a, b in zip(lo, hi)]


def test_sequences_and_rebuilding(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c % 3} {t % 4}") for c in list(range(23)) + [-7, -5] for t in range(c % 11)]
    rows += [(4, None, None, "first"), (9, 2, "user", "2 2"), (None, 0, "user", "no id"), (12, 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS seq", "0 AS weights")
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            k = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            own.setdefault(c, []).append((t is not None, t or 0, k, len(x.encode())))
    own = {c: [(k, w) for _, _, k, w in sorted(v)] for c, v in own.items()}
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        want[c] = own.get(base, [])[:h] + turns[h:]
    got = {r.conv_id: list(zip(map(bytes, r.seq), r.weights)) for r in T.rebuilt(T.sequences(df)).collect()}
    assert got == want
    trie = T.prefix_trie(T.rebuilt(T.sequences(df)))
    assert sorted(map(tuple, trie.collect()), key=str) == brute_trie(want)
    assert T.sequences(df.where("false")).count() == 0

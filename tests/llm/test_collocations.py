"""Phrase collocations against counting every phrase in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chafe.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for p in re.split("[.,;:!?\n\x0b\x0c\r]", low):
        yield re.findall("[^ \t]+", p)


def brute(rows, top, min_count, share):
    out = []
    for lang in {x or "und" for _, _, x in rows}:
        f = Counter()
        for _, text, x in rows:
            if (x or "und") == lang:
                for ws in pieces(text):
                    for s in range(1, 5):
                        f.update(tuple(ws[i:i + s]) for i in range(len(ws) - s + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        inside = Counter()
        for g, c in cand.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    inside[g[i:i + s]] = max(inside[g[i:i + s]], c)
        kept = []
        for g, a in cand.items():
            if 100 * inside[g] < share * a:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]])
                                            for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def random_rows(rng, n, words, phrases):
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append(rng.choice(phrases) if rng.random() < 0.2 else rng.choice(words))
            if rng.random() < 0.1:
                text[-1] += rng.choice([".", ",", "\n", "!", ";", "\r", "  \t"])
        rows.append((i, rng.choice([" ", "\t", "  "]).join(text), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("seed,top,batch", [(0, 5, 1), (1, 20, 1), (2, 1000, 2), (3, 40, 2), (4, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, top, batch):
    """Small batches, so that languages take several rounds."""
    rng = random.Random(seed)
    monkeypatch.setattr(C, "FIRST_BATCH", batch)
    monkeypatch.setattr(C, "BUCKET", 100)
    words = [f"w{i}" for i in range(25)] + ["É", "Ab", "ab", "中文", "x" * 50]
    phrases = [" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(12)]
    rows = random_rows(rng, 150, words, phrases)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS a", "3 AS n")
    got = C.collocations(df, top=top, min_count=3, share=80)
    want = brute(rows, top, 3, 80)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3


def test_threshold_prunes(spark, monkeypatch):
    """With few phrases wanted, most prefixes are never grown."""
    rng = random.Random(7)
    monkeypatch.setattr(C, "BUCKET", 100)
    seen = []
    real = C.phrase_counts

    def spy(docs, size, *args, **kw):
        out = real(docs, size, *args, **kw)
        seen.append((size, out.count()))
        return out
    words = [f"w{int(rng.paretovariate(1.0))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=80)) + " new york city hall", "en") for i in range(200)]
    monkeypatch.setattr(C, "phrase_counts", spy)
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), top=2, min_count=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 5, 80)
    every = Counter()
    for _, t, _ in rows:
        for ws in pieces(t):
            every.update(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    all_three = sum(c >= 5 for c in every.values())
    assert max(n for s, n in seen if s == 3) < 0.5 * all_three


def test_defined_cases(spark):
    text = "a b c. " * 40
    rows = [(1, text, "en"), (1, text, "en"), (2, None, "en"), (3, "", None), (None, "a b " * 30, None), (4, " \n.,", "fr")]
    got = sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows, 2000, 30, 80) and ("en", 1, "a b c", 80, 80, 80, 240, 1_000_000) in got
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame(rows, SCHEMA), longest=5)


def test_long_text_in_blocks_counts_like_a_whole_one():
    rng = random.Random(3)
    text = "".join(rng.choice(["aa", "b", "ccc", "dd"]) + rng.choice([" ", "  ", ". ", "\n", " "]) for _ in range(4000)).encode()
    text += b"z" * 500 + b" a" * 50 + b" " * 700 + b"b a"

    def table(limit, size):
        n = Counter()
        for w in C.blocks([text], limit):
            h = C.hashes(w.distinct, "en", 0)
            cols, counts = C.phrase_table(w, size, h, np.ones(len(w.distinct), bool), None)
            for *g, c in zip(*(x.tolist() for x in cols), counts.tolist()):
                n[tuple(g)] += c
        return n
    for size in (1, 2, 3, 4):
        whole = table(1 << 30, size)
        assert sum(whole.values()) > 100
        assert table(64, size) == whole and table(999, size) == whole


def test_shared_hash_starts_anew(spark, monkeypatch):
    """With the first seed all words share one hash."""
    rows = [(i, "one two three", "en") for i in range(40)]
    seeds, real = [], C.word_counts

    def counts(docs, seed):
        seeds.append(seed)
        out = real(docs, seed)
        return out.withColumn("h", out["h"] * 0 + 5) if seed == 0 else out
    monkeypatch.setattr(C, "word_counts", counts)
    got = C.collocations(spark.createDataFrame(rows, SCHEMA))
    assert seeds == [0, 1] and sorted(map(tuple, got.collect())) == brute(rows, 2000, 30, 80)


def test_score_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    row = spark.range(1).selectExpr(f"CAST({big} AS bigint) AS a", f"CAST({big + 3} AS bigint) AS o")
    assert row.select(C.ratio(row["a"], row["o"]).alias("x")).first().x == 2_000_000 * big // (big + 3)

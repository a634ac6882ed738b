"""Line dedup against a brute-force version."""

import random

import numpy as np

from chafe.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(WS).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_docs=3):
    holders = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [("é" if i % 2 else "") + f"Line number {i} of the shared pool" for i in range(30)] + ["short", "", "x" * 19]
    rows = []
    for d in range(60):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(pool).upper() * rng.choice([0, 1, 1]) + rng.choice(["", "\r"])
                 for _ in range(rng.randint(0, 8))] + [f"own line of document {d} {rng.random()}"]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, pool[0] + "\n" + pool[1]), (3, rows[3][1]), (None, None),
             (73, "\n".join(["very long text, one line of many " + str(i % 50) for i in range(20_000)]))]
    df = spark.createDataFrame([(d, t, 5, "k") for d, t in rows], "doc_id long, text string, n_lines int, key string")
    out = L.dedup_lines(df.repartition(5))
    assert out.columns == ["doc_id", "text", "n_lines", "key", "__n_lines", "__n_dropped"]
    got = sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in out.collect()), key=repr)
    assert got == brute(rows)
    assert {r.text for r in out.where("doc_id = 70").collect()} == {None}


def test_twice_filter_has_no_false_negatives(spark):
    rows = [(d, "\n".join(f"a line that is long enough {i}" for i in range(d % 7, 400, d + 1))) for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    twice = L.twice_seen_filter(df)
    seen = {}
    for d, t in rows:
        for x in set(t.split("\n")):
            seen[x] = seen.get(x, 0) + 1
    repeats = [k.encode() for k, n in seen.items() if n > 1]
    assert L._suspects(repeats, twice) == repeats
    assert len(twice) * 64 <= L.MAX_FILTER_BITS and twice.dtype == np.uint64


def shared_lines(n=90):
    """Documents of shared and own lines; a third of the rows under one id, a line that all hold."""
    rng = random.Random(5)
    pool = [f"Passage number {i} that several documents share" for i in range(40)]
    rows = []
    for d in range(n):
        lines = rng.choices(pool, k=rng.randint(0, 6)) + [f"own line of row {d} {rng.random()}", "a footer that every row holds"]
        rng.shuffle(lines)
        rows.append((7 if d % 3 == 0 else d, "\n".join(lines)))
    return rows + [rows[1], rows[1], (None, pool[0]), (400, None), (401, ""), (402, pool[1] + "\n" + "Ü" * 19)]


def test_filters_dealt_by_hash_equal_brute_force(spark, monkeypatch):
    rows = shared_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def run():
        return sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in L.dedup_lines(df).collect()), key=repr)
    assert run() == brute(rows)
    monkeypatch.setattr(L, "MAX_FILTER_BITS", 64)      # the broadcast filter is out of reach
    monkeypatch.setattr(L, "RANGE_LINES", 50)
    monkeypatch.setattr(L, "_COMBINE", 8)
    monkeypatch.setattr(L, "_by_broadcast", None)
    assert L.filter_bits(L.line_count(df)) > L.MAX_FILTER_BITS
    assert run() == brute(rows)
    assert L.dedup_lines(df.where("false")).count() == 0


def test_crowded_filters_change_nothing(spark, monkeypatch):
    """A bit set far too small suspects every line; the exact step decides as before."""
    rows = shared_lines(40)
    monkeypatch.setattr(L, "MAX_FILTER_BITS", 64)
    monkeypatch.setattr(L, "MIN_FILTER_BITS", 64)
    monkeypatch.setattr(L, "BITS_PER_LINE", 0.01)
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in out.collect()), key=repr) == brute(rows)


def test_clashing_names(spark, monkeypatch):
    rows = [(d, "a line that three documents hold\nown " + "x" * d) for d in range(4)]
    names = ["__suspect", "__new", "__keys", "__row", "__of_id", "__of_row", "__hashes", "id", "row", "key", "h", "__n_lines"]
    df = spark.createDataFrame([(d, t, *["mine"] * len(names)) for d, t in rows],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for limit in (L.MAX_FILTER_BITS, 64):
        monkeypatch.setattr(L, "MAX_FILTER_BITS", limit)
        out = L.dedup_lines(df, counts=("before", "gone"))
        assert out.columns == df.columns + ["before", "gone"]
        got = out.orderBy("doc_id").collect()
        assert [r.text for r in got] == ["own ", "own x", "own xx", rows[3][1]]
        assert all(r[n] == "mine" for r in got for n in names)
        replaced = L.dedup_lines(df)
        assert replaced.columns == [c for c in df.columns if c != "__n_lines"] + ["__n_lines", "__n_dropped"]
        assert {r["__n_lines"] for r in replaced.collect()} == {2}


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""SimHash near-dedup against a brute-force version."""

import random

import xxhash

from chafe.llm import simhash_dedup as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string"


def brute_fp(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(rng, n_groups=6, size=25):
    out = []
    for _ in range(n_groups):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(300)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "Z" * rng.randint(1, 5)
            out.append(" ".join(w))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 1, 7, "x") for d, t in rows], DOCS)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = near_copies(rng) + [None, "", " \n\t", "One", "one two", "ONE two", "é É x\x0bY z"] + ["a b c d e"] * 5
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(5, "a b c d e"), (None, "a b c d e"), (None, "lone words of no id")]
    got = S.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(rows)


def test_linked_by_a_chain_of_two_bit_steps(spark):
    """Links() on bare fingerprints: every pair within two bits is connected."""
    rng = random.Random(5)
    fps, x = set(), rng.getrandbits(63)
    for _ in range(60):
        fps.add(x)
        for b in rng.sample(range(63), 2):
            x ^= 1 << b
    far = {rng.getrandbits(63) for _ in range(50)}
    fps |= far
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    linked = S.links(df).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 for r in linked)
    comp = {r.node: r.label for r in S.connected_components(S.links(df)).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert comp[a] == comp[b]
    assert not set(comp) & {f for f in far if all(f == g or (f ^ g).bit_count() > 2 for g in fps)}


def test_empty_table_and_kept_rows(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "quite another text it is"), (None, "a b c d")]
    kept = S.keep_first_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "component_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3]
    alone = S.keep_first_of_each(frame(spark, [(None, "a b c d"), (None, "a b c d"), (2, "quite another text it is")]))
    assert sorted((r.doc_id for r in alone.collect()), key=repr) == [2, None]


def test_kept_rows_of_repeated_and_null_ids(spark):
    a, b, c, e = "a b c d", "quite another text it is", "one more text of its own", "the last of the texts here"
    rows = [(1, a), (5, a), (5, b), (5, b.upper()), (5, c), (5, c), (7, c), (None, e), (None, e), (None, e.upper()), (8, b)]
    kept = [(r.doc_id, r.text.lower()) for r in S.keep_first_of_each(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (5, b), (5, c), (None, e)], key=repr)


def test_very_long_text():
    text = b"lorem ipsum dolor sit amet " * 40_000
    assert S.simhash64(text) == S.simhash64(text)
    assert S.simhash64(text) == brute_fp(text.decode())

"""Unigram Viterbi over the double array against plain dynamic programming."""

import random

import numpy as np
import public_tokenizers
import pytest

from chafe.llm import sentencepiece_unigram as U

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return U.load_vocabulary(PATH)


def brute(unit, v, pieces, unknown):
    """Best ids of a whole text over a dictionary of pieces, character by character."""
    n = len(unit)
    best, back = [(-np.inf, 0)] * (n + 1), [None] * (n + 1)
    best[0] = (0.0, 0)
    for s in range(n):
        for e in range(s + 1, min(n, s + 16) + 1):
            p = pieces.get(unit[s:e])
            c = v.score[p] if p is not None else unknown if e == s + 1 else None
            if c is not None and best[s][0] + c > best[e][0]:
                best[e], back[e] = (best[s][0] + c, 0), (s, p)
    ids, e = [], n
    while e:
        s, p = back[e]
        ids = ([p] if p is not None else [int(v.byte_id[b]) for b in unit[s:e].encode()]) + ids
        e = s
    return ids


def test_equals_brute_force(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = {sp.id_to_piece(i): i for i in range(32000) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    unknown = vocab.score[np.isfinite(vocab.score)].min() - U.UNKNOWN_PENALTY
    rng = random.Random(4)
    texts = ["", "a", "  two  blanks", "line\n\nfeeds \n", "naïve café 日本語 😀 \x00\t", "mark ▁ in ▁text", "ſẞ́"]
    texts += ["".join(rng.choices("abcdetinoshr  \né😀ж", k=rng.randint(1, 90))) for _ in range(60)]
    texts += ["x" * 500, " " * 70, "international" * 30]
    got = U.Encoder(vocab).encode(texts)
    for t, ids in zip(texts, got):
        if "▁" not in t:
            want = brute("▁" + t.replace(" ", "▁"), vocab, pieces, unknown) if t else []
            assert sum(vocab.score[i] for i in want if vocab.score[i] > -np.inf) == pytest.approx(
                sum(vocab.score[i] for i in ids if vocab.score[i] > -np.inf)), t
            assert U.decode_ids(want, vocab.text) == t
        assert U.decode_ids(ids.tolist(), vocab.text) == t


def test_matrix_and_single_unit_agree(vocab):
    rng = random.Random(9)
    units = {"".join(rng.choices("▁ abcdeéñ日😀ingtion", k=6)) for _ in range(300)}
    for u in units:
        raw = U.unit_bytes(u)
        one = U.viterbi(np.frombuffer(raw, np.uint8).reshape(1, -1), vocab)[0]
        assert one == U.viterbi_long(raw, vocab)


def test_double_array_holds_exactly_its_keys():
    keys = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"b", 3), (b"\xff\x00", 4)]
    base, check, piece = U.double_array(keys)

    def find(k):
        s = 0
        for c in k:
            to = base[s] + c
            if not 0 < to < len(check) or check[to] != s:
                return -1
            s = to
        return piece[s]
    assert [find(k) for k, _ in keys] == [0, 1, 2, 3, 4]
    assert find(b"ac") == find(b"abcd") == find(b"c") == find(b"\xff") == -1


def test_round_trip_in_spark(spark):
    rows = [(1, "Some text.\nMore ▁ of it  "), (2, None), (3, ""), (None, "é😀" * 3000), (1, "Some text.\nMore ▁ of it  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = U.decode(U.encode(df, PATH), PATH).collect()
    assert all(r["__text"] == (r.text or "") for r in out) and len(out) == 5
    assert U.encode(df.where("false"), PATH).count() == 0


def test_one_pass_equals_encode_and_decode(spark):
    rows = [(1, "ab  cd\nef"), (2, None), (3, ""), (4, "\u2581 x" * 30_000), (4, "\u4e2d\u6587 \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = U.decode(U.encode(docs, PATH), PATH)
    one = U.round_trip(docs, PATH)
    key = lambda r: (r[0], str(r[1]))
    assert sorted(([r.doc_id, r.text, r.ids, r.decoded] for r in one.collect()), key=key) == sorted(
        ([r.doc_id, r.text, r["__ids"], r["__text"]] for r in two.collect()), key=key)
    with pytest.raises(ValueError):
        U.round_trip(docs.withColumnRenamed("doc_id", "ids"), PATH)

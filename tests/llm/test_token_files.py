"""Token files: Elias-Fano, the word-wise encoder against the library, round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chafe.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [
    [0], [5], [0, 0, 0], [0, 1, 2, 3], [7] * 1000, [2 ** 63], list(range(0, 10 ** 6, 997)), [0, 2 ** 40, 2 ** 40 + 1]])
def test_elias_fano_select(values):
    ef = T.EliasFano(T.ef_encode(np.array(values, np.uint64)))
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_near_minimal():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 10 ** 8, 50_000).astype(np.uint64))
    raw = T.ef_encode(v)
    ef = T.EliasFano(raw)
    assert all(ef.select(int(i)) == v[i] for i in rng.integers(0, len(v), 500))
    assert len(raw) * 8 / len(v) < 2 + np.log2(10 ** 8 / len(v)) + 1
    assert T.EliasFano(T.ef_encode(np.empty(0, np.uint64))).values().tolist() == []


def test_words_equal_whole_texts():
    rng = random.Random(7)
    whole, own = Tokenizer.from_file(PATH), T.WordEncoder(PATH, 2)
    texts = ["", " ", "Hello, World!!", "it's we'll I'd 'tis rock'n'roll", "naïve CAFÉ straße ÀÖØ×÷ª", "1234 a1b2 3.14,",
             "x\x0by\x0cz\x1c\x1d q r s　t\u0085u", "é e ́x Å K ẞ İi ΑΣ ΑΣ.", "日本語 テスト 😀😀",
             "<|endoftext|> a<|startoftext|>b", "under_score __x__ a-b --", "...,;:!? a.b,c", "a‍b ﻿c", "ﬁ ½ ² Ⅷ"]
    alphabet = "abcXYZéÉßÿ0159 .,;:!?'\"-_\t\n\r\x0b\x0c\x1f ́ 日😀Σ"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(800)]
    for t in texts:
        got = np.frombuffer(own.encode(t.encode()), own.dtype).tolist()
        assert got == whole.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_files_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choices(["alpha", "Beta,", "gamma!", "δ", "x1"], k=rng.randint(0, 40))), "p", 1)
            for d in rng.sample(range(-50, 10 ** 6), 120)]
    rows += [(10 ** 7, None, "p", 1), (10 ** 7 + 1, "", "p", 1), (None, "no id", "p", 1), (None, None, "p", 1),
             (rows[0][0], rows[0][1], "p", 1), (10 ** 12, "very long " * 50_000, "p", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, start int").repartition(4)
    folder = str(tmp_path / "tok")
    T.ROWS_PER_SHARD, keep = 30, T.ROWS_PER_SHARD
    try:
        shards = T.write_shards(df, folder, PATH, 2)
        got = sorted(map(tuple, T.read_shards(shards, folder).collect()), key=lambda r: r[1])
    finally:
        T.ROWS_PER_SHARD = keep
    assert shards.count() > 2
    whole, at, want = Tokenizer.from_file(PATH), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    first = shards.orderBy("shard").first()
    f = T.TokenFile(T.file_system(folder)[0], first.path)
    assert [len(f.ids(i)) for i in range(f.n_docs)] == [w[2] for w in want[:f.n_docs]]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    shards = T.write_shards(df, str(tmp_path / "none"), PATH, 2)
    assert T.read_shards(shards, str(tmp_path / "none")).count() == 0

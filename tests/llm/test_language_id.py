"""Cross-parsing language ID: automaton and parse against brute force, accuracy."""

import random
import zlib

import numpy as np
import pytest

from chafe.llm import language_id as N


def brute_phrases(symbols, text):
    """Greedy longest-match parse of the whole text by substring search."""
    known, p, n, i = text.tobytes(), symbols.astype(np.uint8).tobytes(), 0, 0
    while i < len(p):
        j = i + 1
        while j <= len(p) and p[i:j] in known:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("piece, block", [(512, 4_000_000), (7, 4_000_000), (1, 50), (64, 900)])
def test_parse_equals_brute_force(piece, block, monkeypatch):
    monkeypatch.setattr(N, "PIECE", piece)
    monkeypatch.setattr(N, "BLOCK_SYMBOLS", block)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, w, 600).astype(np.uint8) for w in (3, 5)]
    tables, starts, at = [], [], 0
    for t in texts:
        x = N.suffix_automaton(t, 8)
        starts.append(at + 1)
        tables.append(np.where(x > 0, x + at, 0))
        at += len(x)
    m = N.LanguageModel(["a", "b"], N._letters(), np.concatenate(tables).astype(np.int32), np.array(starts), np.ones(2))
    docs = [rng.integers(0, 7, n).astype(np.uint8) for n in (0, 1, 2, 30, 511, 512, 513, 1500)]
    docs += [texts[0][50:300], np.full(40, 7, np.uint8), np.tile(texts[1], 3), np.zeros(2000, np.uint8)]
    got = m.phrases(docs)
    for d, row in zip(docs, got):
        assert row.tolist() == [brute_phrases(d, t) for t in texts]


def test_automaton_knows_exactly_the_substrings():
    t = N.suffix_automaton(np.frombuffer(b"\0\1\0\1\1\2", np.uint8), 3)

    def has(word):
        s = 1
        for c in word:
            s = t[s, c]
            if not s:
                return False
        return True
    text = b"\0\1\0\1\1\2"
    for n in range(1, 5):
        for code in range(3 ** n):
            w = bytes(code // 3 ** k % 3 for k in range(n))
            assert has(w) == (w in text)


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(6)
    syllables = {"aa": "ka ti ro mu sen".split(), "bb": "üb sch ein ver keit".split(), "cc": "eau oi tion é qu".split()}
    rows = []
    for d in range(300):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        rows.append((d, text, lang, "s", 1.0))
    extra = [(900, None, "aa", "s", 0.0), (901, "", "aa", "s", 0.0), (902, "12 - 3!", "bb", "s", 0.0),
             (903, "漢字", None, "s", 0.0), (None, "ka ti ro", "cc", "s", 0.0), (1, rows[1][1], "zz", "s", 0.0),
             (904, "schein verkeit " * 20_000, None, "s", 0.0)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, lang_pred string, score double")
    got = N.identify(df).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[900] == by[901] == by[902] == "und" and by[904] == "bb" and by[903] != "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_that_share_a_script_of_many_letters(spark):
    """Words of two letters of 400, the same letters in both languages."""
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(400)]
    words = {"aa": [], "bb": []}
    for own in words.values():
        order = rng.sample(letters, len(letters))
        own += ["".join(order[i:i + 2]) for i in range(0, 400, 2)]
    rows = []
    for d in range(300):
        lang = rng.choice(list(words))
        rows.append((d, "".join(rng.choices(words[lang], k=rng.randint(30, 60))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [r for r in N.identify(df).collect() if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == rows[r.doc_id][2] for r in held) / len(held) > 0.97


def test_sparse_transitions_equal_the_dense_table():
    rng = np.random.default_rng(5)
    table = np.where(rng.random((700, 90)) < 0.05, rng.integers(1, 700, (700, 90)), 0).astype(np.int32)
    state, symbol = np.repeat(np.arange(700), 90).reshape(90, 700), np.tile(np.arange(90), 700).reshape(90, 700)
    assert (N.Transitions.of_table(table).step(state, symbol) == table[state, symbol]).all()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in N.identify(df).collect()] == ["und"]
    assert N.identify(df.where("false")).count() == 0


def test_sampled_rows_are_bounded_and_whole(spark):
    """A hot id and a hot text take one place; texts past 16,000 characters stay whole."""
    long = "wort " * 20_000
    rows = [(1, "immer derselbe text", "de")] * 200 + [(1, f"text {i}", "de") for i in range(200)] + [(2, long, "en")]
    got = N.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    texts = [r.text for r in got if r.lang == "de"]
    assert len(texts) == len(set(texts)) == N.TRAIN_DOCS
    assert [r.text for r in got if r.lang == "en"] == [long]

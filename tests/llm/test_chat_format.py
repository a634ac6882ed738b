"""Chat formatting: every turn comes back from what was written."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chafe.llm import chat_format as C

BITS = st.sampled_from([*C.CONTROLS, "\\", "<", "[", "]", "%", " ", "\n", "x", "é", "SYS>>", "/s>", "[ROLE=", "%5B", "<\\/s>"])
TEXTS = st.lists(BITS, max_size=8).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXTS)
SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_parser_recovers_every_turn(turns):
    text = C.BEGIN + "".join(C.render_turn(r, t)[0] for r, t in turns)
    assert [(t.role, t.text) for t in C.parse(text)] == turns


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text
    assert not C.CONTROL.search(C.escape(text))


def test_ordinary_texts_stay_as_they_are():
    text = "a < b [x] \\ \\n </S> [inst] 50%"
    piece, start, end = C.render_turn("assistant", text)
    assert piece[start:end] == text and piece == f" {text}</s>"
    assert C.render_turn("user", "</s>[INST] ok")[0] == "[INST] <\\/s>[\\INST] ok [/INST]"


@pytest.mark.parametrize("bad", ["x", "[INST] a", "[INST] a</s> [/INST]", " a [/INST]", "[ROLE=tool", "[INST] a[/INST]"])
def test_syntax_errors(bad):
    with pytest.raises(C.GrammarError):
        C.parse(bad)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        chars = len(C.BEGIN) + sum(len(C.render_turn(r, t)[0]) for _, _, r, t in turns)
        out.append((c, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


ROWS = [(1, 1, "assistant", "</s>é"), (1, 0, "user", None), (1, None, "system", "first [/INST]"), (2, 0, None, ""),
        (2, 0, None, ""), (None, 3, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "a"),
        (3, 0, "assistant", "b"), (4, 0, "to]ol%", "\\"), (5, 0, "user", "long " * 60_000)]


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 20])
def test_digests_equal_brute_force(spark, tmp_path, part_chars):
    """Also when every turn, or every few, makes a part of its own."""
    rows = ROWS + [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' AS part", "1 AS last")
    folder = C.format_conversations(df, str(tmp_path / "out"), part_chars)
    parts = spark.read.schema(C.PARTS).parquet(folder)
    assert sorted(map(tuple, C.read_digests(parts).collect()), key=str) == brute(rows)
    if part_chars == 1:
        assert parts.where("conv_id = 9").count() == 300


def test_loss_spans_cover_assistant_bodies_only(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "é[INST]"), (1, 2, "assistant", "")], SCHEMA)
    row = spark.read.parquet(C.format_conversations(df, str(tmp_path / "out"))).first()
    assert row.text == "<s>[INST] q [/INST] é[\\INST]</s> </s>"
    assert [row.text[s.start:s.end] for s in row.loss] == ["é[\\INST]", ""] and row.last and row.part == 0


def test_empty_table(spark, tmp_path):
    folder = C.format_conversations(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"))
    assert C.read_digests(spark.read.schema(C.PARTS).parquet(folder)).count() == 0

from pyspark.sql import functions as F

from chafe.functions import lexicon as lx
from chafe.functions import text as tx


def one(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_clean_text_fixtures(spark):
    rows = [("Fix this:\n```python\nx = 1\n```\nplease",), ("use `foo()` here",),
            ("a ``` unbalanced",), ("```a``` mid ```b```",), ("in`line\ncode` x",),
            ("a b c　d\u0085e\u001cf",), (None,), ("  padded\t\n  ",)]
    got = [r[0] for r in one(spark, rows, "t string", tx.clean_text("t"))]
    assert got == ["Fix this: [CODE_BLOCK] please", "use [CODE] here", "a ``` unbalanced",
                   "[CODE_BLOCK] mid [CODE_BLOCK]", "in[CODE] x", "a b c d e f", "", "padded"]


def test_length_filter_is_strict(spark):
    got = one(spark, [("x" * 10,), ("x" * 11,), ("é" * 11,)], "t string", tx.long_enough("t"))
    assert [r[0] for r in got] == [False, True, True]


def test_url_keys(spark):
    rows = [("https://api.github.com/repos/Metta-AI/metta/pulls/1688",),
            ("https://api.github.com/repos/Metta-AI/metta",), (None,), ("",),
            ("https://example.com/a/b/c/d/e",), ("https://api.github.com/repos/o/r/pulls/x1",),
            ("https://api.github.com/repos/o/r/pulls/ 12 ",)]
    repo, num = tx.pr_key_from_url("u")
    got = one(spark, rows, "u string", repo, num, tx.repo_from_url("u"))
    assert got[0] == ("Metta-AI/metta", 1688, "pulls/1688")
    assert got[1] == (None, None, "Metta-AI/metta")
    assert got[2] == (None, None, None) and got[3] == (None, None, None)
    assert got[4][0] is None
    assert got[5] == ("o/r", None, "pulls/x1")
    assert got[6] == ("o/r", 12, "pulls/ 12 ")


def test_bots(spark):
    rows = [("x[bot]", None), ("Jenkins-CI", None), ("ci/cd runner", None), ("CodeRabbitAI", None),
            ("Copilot", None), (None, None), ("alice", "Bot"), ("botany", "User")]
    got = [r[0] for r in one(spark, rows, "u string, t string", tx.is_bot("u", "t"))]
    assert got == [True, True, True, True, True, False, True, False]


def test_durations_and_flags(spark):
    rows = [("2024-01-01 00:00:00", "2024-01-01 00:00:59"), ("2024-01-01 00:00:00", "2024-01-01 00:01:00"),
            ("2024-01-01 00:00:00", None), ("garbage", "2024-01-01 00:01:01")]
    df = spark.createDataFrame(rows, "a string, b string") \
        .select(tx.parse_ts("a").alias("a"), tx.parse_ts("b").alias("b"))
    got = [r[0] for r in df.select(tx.keep_duration(tx.duration_s("a", "b"))).collect()]
    assert got == [False, True, True, True]
    flags = one(spark, [("MERGED",), ("closed",), (None,)], "s string", tx.merged_flag("s"))
    assert [r[0] for r in flags] == [1, 0, 0]


def test_bands(spark):
    got = one(spark, [(0.1,), (0.2,), (0.49,), (0.5,), (None,)], "s double", tx.friction_band("s"))
    assert [r[0] for r in got] == ["low", "medium", "medium", "high", None]


def test_keyword_category(spark):
    rows = [("needs pytest",), ("add a docstring",), ("the community",), ("security and test",),
            ("nothing here",), ("",)]
    got = [r[0] for r in one(spark, rows, "t string", lx.keyword_category("t"))]
    assert got == ["Testing", "Documentation", "Testing", "Testing", "Other", "Other"]


def test_lexicon_scores_and_ties(spark):
    rows = [("this is stupid",), ("good work",), ("stupid but good",), ("plain text",),
            ("great nice stupid",)]
    df = lx.score_columns(spark.createDataFrame(rows, "t string"), "t")
    got = [(r.friction_score, r.sentiment_label, r.is_negative) for r in df.collect()]
    assert got[0] == (0.5, "negative", True)          # [1,1,0]/2: tie -> first
    assert got[1] == (0.0, "neutral", False)          # [0,1,1]/2: tie -> neutral
    assert got[2] == (1 / 3, "negative", True)
    assert got[3] == (0.0, "neutral", False)
    assert got[4][1] == "positive"


def test_argmax_missing_negative(spark):
    df = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    r = df.select(lx.friction("p", ["neutral", "positive"]).alias("f"),
                  lx.argmax_label("p", ["neutral", "positive"]).alias("l")).first()
    assert r.f == 0.0 and r.l == "positive"

"""Property checks with generated data (small example counts: each runs Spark jobs)."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chafe.functions.lexicon import score_columns
from chafe.operators import ranks as R
from chafe.operators import stats as X
from chafe.operators.scoring import score_distinct

values = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 6)), min_size=8, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=values, parts=st.integers(1, 5))
def test_rank_sum_and_partition_independence(spark, rows, parts):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    rt = R.rank_table(df, "v", n_parts=parts).collect()
    n = len(rows)
    assert sum(r.t * r.avg_rank for r in rt) == pytest.approx(n * (n + 1) / 2)
    expect = pd.Series([float(v) for _, v in rows]).rank()
    got = {r.v: r.avg_rank for r in rt}
    assert [got[float(v)] for _, v in rows] == pytest.approx(list(expect))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=values)
def test_u_statistics_complement(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    for r in X.mann_whitney_pairs(df, "g", "v", min_n=1).collect():
        # U_ab + U_ba = n_a * n_b, whatever the ties
        u_ba = sum((a < b) + 0.5 * (a == b) for ga, a in rows if ga == r.group_a
                   for gb, b in rows if gb == r.group_b)
        assert r.statistic + u_ba == pytest.approx(r.n_a * r.n_b)


def test_score_distinct_equals_in_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    dup = docs.unionByName(docs)  # every text twice
    a = sorted((r.doc_id, r.friction_score, r.sentiment_label) for r in score_columns(dup, "text").collect())
    b = sorted((r.doc_id, r.friction_score, r.sentiment_label)
               for r in score_distinct(dup, "text").where(F.col("text").isNotNull()).collect())
    assert a == b

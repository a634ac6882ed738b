"""Registered queries: driver contract and the DuckDB oracle on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from chafe.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
CHECKED = ["friction_by_group", "clean_text_len", "url_keys", "quick_close_filter", "items_union",
           "bot_filter", "quality_funnel", "shares", "sentiment_by_source", "category_matrix",
           "monthly_trend", "kruskal_events", "mann_whitney_pairs", "chi2_lang_source",
           "spearman_by_group", "box_stats", "histogram", "density", "ctfidf_top", "model_score"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.columns == ["source", "mean", "count", "std"]
    assert df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm(df.columns, df.collect()) == _norm(rel.columns, rel.fetchall())

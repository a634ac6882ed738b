"""Registered queries against their SQL in DuckDB, and the pipeline."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from chafe.llm import decontaminate, sentencepiece_unigram, simhash_dedup, toxicity
from chafe.llm.common import table
from chafe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_pipeline_equals_brute_force(spark):
    """Every stage redone in plain Python over what the stage before kept (the
    classifier itself, which has no brute-force form, is fitted once more)."""
    from test_decontaminate import brute as leaks
    from test_line_dedup import brute as lines
    from test_simhash_dedup import brute as groups

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    docs = [(d, t) for d, t in docs if model.score(t) < toxicity.THRESHOLD]
    docs = [(d, t) for d, _, _, t in lines(docs)]
    docs = [(d, t) for d, t in docs if (d in {c for _, _, c in groups(docs)})]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    near = {r.doc_id for r in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), table(spark, SF, "benchmark")).collect()}
    short = [(d, t) for d, t in docs if len(t) < 4000]
    assert {d for d, _ in leaks(short, items)} == near & {d for d, _ in short}
    docs = [(d, t) for d, t in docs if d not in near]
    encoder = sentencepiece_unigram.Encoder(sentencepiece_unigram.load_vocabulary(P.VOCABULARY))
    want = sorted((d, ids.tolist(), len(ids), t) for (d, t), ids in zip(docs, encoder.encode([t for _, t in docs])))
    got = sorted((r.doc_id, r.ids, r.n_ids, r.text) for r in P.run(spark, SF).collect())
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents").limit(30)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert simhash_dedup.keep_first_of_each(docs.where("false")).count() == 0

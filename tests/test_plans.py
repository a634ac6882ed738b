"""Plan checks: pushdown/pruning, no Python in the hot path, no global
windows over fact rows."""

from chafe.operators import ranks as R
from chafe.plans.common import clean_documents
from chafe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_stays_in_jvm_and_prunes(spark):
    plan = _plan(QUERIES["friction_by_group"](spark, SF))
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan or \
        "text:string" in plan and "n_chars" not in plan


def test_item_pipeline_pushes_filters(spark):
    plan = _plan(QUERIES["items_union"](spark, SF))
    assert "PythonUDF" not in plan
    assert "PushedFilters" in plan


def test_rank_table_has_no_global_window(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    plan = _plan(R.rank_table(ev, "value"))
    # every window over fact-sized rows is partitioned by the range partition id
    for line in plan.splitlines():
        if "Window [" in line and "sum(t" in line:
            assert "_pid" in line


def test_documents_scan_is_pruned(spark):
    plan = _plan(clean_documents(spark, SF))
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]

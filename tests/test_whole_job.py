"""Queries on task types take every customer's orders; texts are worked on once."""

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_every_customer_gives_its_orders_a_type(spark):
    q = E.queries()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    untyped = orders.join(customers, orders.o_custkey == customers.c_custkey, "left_anti").count()
    types = {r.pr_type: r["count"] for r in q["task_type_join"](spark, SF).collect()}
    assert types.get("unknown", 0) <= untyped
    items = q["items_union"](spark, SF)
    typed = items.where(F.col("pr_type") != "unknown").count()
    assert untyped or typed == items.count()
    assert sum(r["count"] for r in q["type_stats"](spark, SF).collect()) == typed
    assert {r.pr_type for r in q["negative_rate"](spark, SF).collect()} == set(types) - {"unknown"}


def test_texts_are_cleaned_and_urls_taken_apart_once(spark):
    from chafe.plans.common import scored_items
    plan = scored_items(spark, SF).select("agent", "friction_score")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    # two text tables, one cleaning each, above the step that deals rows out
    assert sum("regexp_replace" in x for x in lines) == 2
    # the key of a line's URL is made in one place: no pushed filter makes it again
    assert sum("Contains(concat(/, pull_request_url" in x for x in lines) == 1
    assert not any("l_orderkey" in x and "/pulls/" in x and " Filter " in x for x in lines)


def test_keys_from_odd_urls(spark):
    from chafe.functions import text as tx
    urls = ["a/b/c/repos/o/r/7", "repos/o/r/pulls/7", "a/b/repos/o/r/pulls/ 7 ", "a/b/repos/o/r/pulls/x", "a/b/myrepos/o/r/pulls/7",
            "a/b/repos//r/pulls/7", "a/b/repos/o/r/pulls/7/", "", "a/b/c/o/r/7/repos", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    repo, num = tx.pr_key_from_url("u")
    got = [tuple(r) for r in df.orderBy("i").select(repo, num, tx.repo_from_url("u")).collect()]

    def want(u):
        p = u.split("/") if u is not None else []
        ok = len(p) >= 7 and "repos" in p
        n = p[-1].strip(" ") if ok else ""
        return ("/".join(p[-4:-2]) if ok else None, int(n) if n.isdigit() else None,
                "/".join(p[-2:]) if len(p) >= 5 and "repos" in p else None)
    assert got == [want(u) for u in urls]


def test_items_union_joins_no_texts(spark):
    plan = E.queries()["items_union"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # no join passes a text on: what a text is needed for is made below them
    passed = [x.split("Project [")[1] for i, x in enumerate(plan) if "Project [" in x and "Join " in plan[i + 1]]
    assert passed and not any("clean_body" in x for x in passed)


def test_facts_hold_the_key_of_their_text(spark):
    from chafe.plans.common import counted_items, scored_items
    from chafe.session import scratch_table
    items, funnel = counted_items(spark, SF, texts_apart=True)
    assert "clean_body" not in items.columns
    facts = scratch_table(items)
    want = scored_items(spark, SF).select("source", "item_id", "friction_score", F.md5("clean_body").alias("text_md5"))
    got = facts.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    counts = {(t, s): n for t, _, s, n in funnel.counts()}
    assert counts["comments", "long_enough"] + counts["reviews", "long_enough"] == facts.count()


def test_cosine_copies_no_vector_for_each_pair(spark):
    from chafe.operators.cosine import cosine_pairs
    vectors = spark.createDataFrame([(f"k{i}", f"t{j}", 1.0 + (i * j) % 3) for i in range(6) for j in range(5)],
                                    "key string, term string, score double")
    pairs = cosine_pairs(vectors, "key", 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    # the pairs only filter; vectors meet by term alone
    inner = [x for x in plan.splitlines() if "Join Inner" in x]
    assert "Join LeftSemi" in plan and len(inner) == 1 and "(term#" in inner[0]
    assert pairs.count() == 15

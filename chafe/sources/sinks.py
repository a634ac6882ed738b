"""Result sinks (S6-S9): CSV result tables, parquet fact tables, the text
summary, model persistence and a long table of all test results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv",
                  single_file: bool = True) -> list[str]:
    """One folder per result table.  Result tables are aggregates (a few
    rows), so one CSV part file each keeps them readable; fact tables should
    use ``fmt='parquet'`` with ``single_file=False``."""
    paths = []
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = (df.repartition(1) if single_file else df).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", "true").csv(path)
        else:
            w.format(fmt).save(path)
        paths.append(path)
    return paths


def write_facts(df: DataFrame, table: str, key: str = "id_pr", buckets: int | None = None) -> DataFrame:
    """Facts as a table of the session catalog, bucketed and sorted by ``key``.

    Joins and aggregates on the key then read each bucket where it lies: the
    shuffle of the write is the last one on that key.  ``buckets`` is by default
    the session's number of shuffle partitions."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # one task a bucket, so that a bucket is one file
    df.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def summary_lines(items: DataFrame, tests: DataFrame | None = None, agent: str = "agent",
                  score: str = "friction_score", negative: str = "is_negative") -> DataFrame:
    """The run summary as ordered text lines: totals, per-source and
    per-agent counts, mean friction, and each test's statistic and p-value."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("m"),
                      F.avg(F.col(negative).cast("double")).alias("r")) \
        .select(F.lit(0).alias("section"), F.lit("").alias("key"),
                F.format_string("Total items analyzed: %d | mean friction %.4f | negative %.1f%%",
                                "n", "m", F.col("r") * 100).alias("line"))
    by_source = items.groupBy("source").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(1).alias("section"), F.col("source").alias("key"),
                F.format_string("  %s: %d", "source", "n").alias("line"))
    by_agent = items.groupBy(agent).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("m")) \
        .select(F.lit(2).alias("section"), F.col(agent).alias("key"),
                F.format_string("  %s: %d items, mean friction %.4f", agent, "n", "m").alias("line"))
    parts = [total, by_source, by_agent]
    if tests is not None:
        parts.append(tests.select(F.lit(3).alias("section"), F.col("test").alias("key"),
                                  F.format_string("  %s: stat=%.4f, p=%.4g", "test", "statistic",
                                                  "p_value").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_summary(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "key").select("line").repartition(1).write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    """Spark ML writer (pipelines, fitted topic and scorer models)."""
    model.write().overwrite().save(path)


def results_long(tests: Mapping[str, DataFrame]) -> DataFrame:
    """Every one-row test result stacked into ``test, n, statistic, p_value``."""
    out = None
    for name, t in tests.items():
        part = t.select(F.lit(name).alias("test"), F.col("n").cast("long").alias("n"),
                        F.col("statistic").cast("double").alias("statistic"),
                        F.col("p_value").cast("double").alias("p_value"))
        out = part if out is None else out.unionByName(part)
    return out

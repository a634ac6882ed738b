"""Scans and source checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def table_path(base: str, name: str) -> str:
    base = base.rstrip("/")
    return f"{base}/{name}.parquet"


def load_table(spark: SparkSession, base: str, name: str,
               schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one named table.  Parquet carries its own schema; columns of a given
    ``schema`` are cast to it, a value that doesn't fit becoming null."""
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(table_path(base, name) if fmt == "parquet" else f"{base.rstrip('/')}/{name}.{fmt}")
    if schema is not None and fmt == "parquet":
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name)
                         for f in schema.fields if f.name in df.columns])
    return df


def load_tables(spark: SparkSession, base: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: load_table(spark, base, n) for n in names}


def inspect_source(df: DataFrame, k: int = 10) -> tuple[list[tuple[str, str]], DataFrame]:
    """Column list plus a lazy one-row view of the first ``k`` columns."""
    return df.dtypes, df.select(*df.columns[:k]).limit(1)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """S3: raise when a table is empty (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def pick_column(df: DataFrame, candidates: Sequence[str], required: bool = False) -> str | None:
    """First candidate column present in ``df`` (metadata only)."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def quality_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows surviving each cumulative filter, in one scan.

    ``steps`` is an ordered list of (name, predicate); row i of the result is
    the count of rows passing predicates 1..i.  A single aggregate with
    conditional sums replaces one count job per step.
    """
    aggs = [F.count(F.lit(1)).alias("s0")]
    acc = F.lit(True)
    for i, (_, pred) in enumerate(steps, start=1):
        acc = acc & F.coalesce(pred, F.lit(False))
        aggs.append(F.sum(F.when(acc, 1).otherwise(0)).cast("long").alias(f"s{i}"))
    wide = df.agg(*aggs)
    names = ["input"] + [n for n, _ in steps]
    stack = ", ".join(f"{i}, '{n}', s{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (step_no, step, n_rows)") \
        .select(F.col("step_no").cast("int").alias("step_no"), "step",
                F.col("n_rows").cast("long").alias("n_rows"))

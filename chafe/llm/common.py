"""Helpers that the operators share: scans, written intermediates, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ASCII white space as the contracts define it: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
# Rows of an Arrow batch: texts can be long, so batches are small in rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: at most BATCH_ROWS texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def byte_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound an Arrow batch in bytes as well, for rows that can be long."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def scratch(spark: SparkSession) -> str:
    """Folder for written intermediates below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written once in the shared folder.

    Unlike ``checkpoint`` of an unpersisted plan this computes the plan once,
    and the table is columnar and compressed.  Lost executors only repeat
    tasks that read it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediates (after results were written)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)


def crc32_bucket(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def text_key(text: str = "text") -> Column:
    """64-bit hash of the text (null as empty): with the id, the key of a row whose id
    is null or repeated."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch],
                schema: str) -> DataFrame:
    """One Arrow batch in, one out; the plan keeps its partitioning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")

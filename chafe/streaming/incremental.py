"""Incremental scoring with Structured Streaming.

The reference scores a finished table in one batch.  The same preparation
and scoring expressions run unchanged on a file stream: new parquet files
of review text are cleaned, filtered and scored as they land, and the
scored rows are appended to a parquet table (exactly-once through the
checkpointed file sink).  Per-group summaries are then plain batch
aggregates over that table.  No state is kept between batches: every
operator here is row-wise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.lexicon import assign_category, keyword_category, score_columns
from ..functions.text import clean_text, long_enough


def score_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Row-wise clean -> length filter -> lexicon score -> category."""
    c = stream.withColumn("clean_body", clean_text(text)).where(long_enough("clean_body"))
    s = score_columns(c, "clean_body")
    return s.withColumn("friction_category",
                        assign_category("is_negative", keyword_category("clean_body")))


def start_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                  checkpoint_dir: str, text: str = "text", trigger_once: bool = False,
                  max_files_per_trigger: int | None = None):
    """Start a file-source -> parquet-sink scoring query; returns the handle."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    scored = score_stream(reader.load(source_dir), text)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()

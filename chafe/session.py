"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every session used by this library should carry.  Shuffle partition
# count is left to the caller: on a cluster it is sized to the data, locally to
# the core count.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "chafe", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local-mode session without the setting (tests, the driver's
    smoke run) gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="chafe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (not local) checkpoint: survives executor loss, freezes the
    rows of non-deterministic steps such as sampled range boundaries."""
    ensure_checkpoint_dir(df.sparkSession)
    # Without a persisted copy the eager checkpoint computes the plan twice:
    # once for its count job and again for the job writing the files.
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist(blocking=False)


def scratch_table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint folder, and read from there.

    Unlike ``cut_lineage`` it keeps nothing in executors' memory and computes the
    plan once; the partitioning is the files', not the plan's."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def redistribute(df: DataFrame) -> DataFrame:
    """Round-robin rows before CPU-heavy text work.

    Cleaning and scoring cost far more per byte than a shuffle does, and a
    scan's tasks follow its files' row groups, which can be few and uneven.  The
    same step runs at every input size."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))


def where_here(df: DataFrame, predicate: Column) -> DataFrame:
    """``df.where(predicate)`` that the optimizer leaves where it is written.

    Predicates on derived columns would otherwise sink, with all that the columns
    are made from, below joins and ``redistribute`` into the scan's few tasks, and
    be worked out twice or more.  A row number in the projection below pins it
    (a comparison with ``rand`` would be folded away)."""
    here = "_here"
    return df.withColumn(here, F.monotonically_increasing_id()).where(predicate | (F.col(here) < 0)).drop(here)


# Largest per-group table that is broadcast, in bytes of its values; beyond it the join is shuffled.
MAX_BROADCAST_BYTES = 16 << 20


def value_bytes(df: DataFrame) -> Column:
    """Bytes that a row's values take: strings, binaries and arrays as long as they are."""
    total = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c))) + 16
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8))
    return total.cast("long")


def group_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A table of one row per group, ready to be joined to facts on its key.

    It is written and its bytes are summed up first.  Up to ``max_bytes`` it is
    broadcast, so a group with a third of all facts is not gathered in one task;
    beyond that a sort-merge join is left to AQE, which splits a hot group because
    neither side is an aggregate's own output."""
    small = cut_lineage(df)
    size = small.agg(F.coalesce(F.sum(value_bytes(small)), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= max_bytes else small

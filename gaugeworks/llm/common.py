"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, configure

#: Rows per Arrow batch: whole texts are long, so batches stay small.
ARROW_ROWS = 256
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    # groups of small lists and sketches are hashed up to this many a task before they are sorted
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, package shipping and the Arrow batch bound (idempotent)."""
    configure(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation, and a
    row's place (partition, number in it) stays what the first run gave it.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: int, per_task: int, spark: SparkSession) -> int:
    """Number of groups so that each holds about ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def text_bytes(col: str):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


#: Largest table that is sent whole to every executor.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows fit BROADCAST_BYTES; a shuffled join beyond it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df

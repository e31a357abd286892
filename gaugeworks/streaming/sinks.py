"""Idempotent stream sinks (S9/R11), a progress table (S10) and per-batch
config reload (R12).

Structured Streaming replays a micro-batch after a failure (at-least-once
delivery). ``insert_ignore_sink`` makes the effect exactly-once: each
micro-batch keeps the first row per key, drops keys already in the target
(left anti join against the target's key columns) and appends the rest.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import insert_ignore
from ..sources.stored import read_epoch, read_if_exists, write_epoch


@contextmanager
def batch_partitions(spark, per_core: int = 2):
    """Start streams in here: their shuffles get at most ``per_core`` partitions per core.

    ``spark.sql.shuffle.partitions`` is set for a job's whole input, while a micro-batch has a bounded
    number of rows. Every micro-batch commits each partition's state and writes each one's files, so with
    a count that grows with the input, as the number of micro-batches does, the time grows with its square.
    A started stream keeps the count it began with, also after a restart.
    """
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(int(old), max(2, per_core * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def insert_ignore_sink(path: str, keys: list[str], order: str | None = None, partition_by: list[str] | None = None):
    """``foreachBatch`` writer with ``ON CONFLICT (keys) DO NOTHING`` semantics.

    With ``partition_by`` (columns that are part of the key and partition the
    target) only the target partitions present in the batch are read.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        target = read_if_exists(spark, path)
        if target is not None and partition_by:
            # Keys can only collide inside the partitions the batch touches: a
            # semi join on the partition columns, which Spark prunes dynamically.
            target = target.join(batch.select(*partition_by).distinct(), partition_by, "left_semi")
        rows = insert_ignore(batch, target, keys, order) if target is not None else \
            insert_ignore(batch, batch.limit(0), keys, order)
        rows = rows.checkpoint(eager=True)
        w = rows.write.mode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)

    return write


def gap_sink(path: str, state_path: str, stream: str = "stream_id", seq: str = "sequence", order: list[str] | None = None, chunk=None):
    """``foreachBatch`` gap monitor; forward jumps go to ``path``, once each.

    A micro-batch is scanned in chunks of its order (as in W2), so one busy
    stream is many tasks; what earlier batches saw is one maximum per stream,
    kept per epoch at ``state_path``. A replayed epoch starts from the same
    state, finds the same gaps and adds none twice.
    """
    from ..functions import scan
    order = order or ["arrival_ts", "arrival_id"]

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch.groupBy(stream).agg(F.max(seq).alias("_max"))
        prev = read_epoch(spark, state_path, before=epoch_id)
        rows = scan.running_max_before(batch, stream, order, seq, chunk=chunk, out="_prev")
        if prev is not None:
            rows = rows.join(prev, stream, "left").withColumn("_prev", F.greatest("_prev", "_max")).drop("_max")
            seen = seen.unionByName(prev).groupBy(stream).agg(F.max("_max").alias("_max"))
        gaps = rows.where(F.col("_prev").isNotNull() & (F.col(seq) > F.col("_prev") + 1)).select(
            stream, (F.col("_prev") + 1).alias("expected_seq"), F.col(seq).alias("observed_seq"), (F.col(seq) - F.col("_prev") - 1).alias("missing_count"))
        insert_ignore_sink(path, [stream, "observed_seq"])(gaps, epoch_id)
        write_epoch(seen, state_path, epoch_id)

    return write


def sync_state_sink(path: str, sync_id: str = "ledger", seq_col: str = "sequence"):
    """The highest processed sequence, one row per sync id, as a folder per epoch.

    Each epoch's state is the newest earlier one merged with the batch; nothing
    is overwritten in place, and a replayed epoch gives the same folder again.
    Read it with :func:`sync_state`.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        cur = batch.agg(F.max(seq_col).alias("last_synced")).withColumn("sync_id", F.lit(sync_id)) \
                   .withColumn("epoch_id", F.lit(epoch_id).cast("bigint"))
        old = read_epoch(spark, path, before=epoch_id)
        if old is not None:
            cur = old.unionByName(cur).groupBy("sync_id").agg(F.max("last_synced").alias("last_synced"),
                                                              F.max("epoch_id").alias("epoch_id"))
        write_epoch(cur, path, epoch_id)

    return write


def sync_state(spark, path: str) -> DataFrame | None:
    """The newest committed state of :func:`sync_state_sink`, or None."""
    return read_epoch(spark, path)


def with_current_config(load_config, apply):
    """Re-read a small config table at every micro-batch and apply it.

    ``load_config(spark)`` returns the config DataFrame (read fresh each
    batch, so a new version takes effect at the next batch boundary and a
    whole batch always uses one version); ``apply(batch, config, epoch_id)``
    does the work.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        cfg = load_config(batch.sparkSession)
        apply(batch, cfg, epoch_id)

    return write

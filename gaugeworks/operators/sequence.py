"""Ordered logs: idempotent append (S9), dense per-tenant sequences (W3, A10),
gap detection (W2), every-Nth triggers (W13), ledger catch-up plan (W14),
ledger lag (W15), ledger pages to transactions (S12), open batch (W4) and
batch contiguity (W5).

Ordered per-key work goes through ``functions.scan`` so a hot key is split
into chunks instead of sorting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan

# Fixed values from the ledger follower.
MAX_GAP = 172_800
CHECKPOINT_INTERVAL = 64
DEFAULT_CONCURRENCY = 10


def insert_ignore(incoming: DataFrame, target: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is not yet in ``target``.

    Duplicate keys inside ``incoming`` keep the first row by ``order`` (an
    aggregate with ``min_by``, which is partially aggregated before the
    shuffle, so a hot key does not gather its copies in one task). Append
    the result to the target to get ``ON CONFLICT DO NOTHING``.
    """
    cols = [c for c in incoming.columns if c not in keys]
    if order is not None:
        first = (incoming.groupBy(*keys)
                         .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
                         .select(*keys, "_row.*"))
    else:
        first = incoming.dropDuplicates(keys)
    return first.join(target.select(*keys), keys, "left_anti")


def append_sequences(stored: DataFrame, incoming: DataFrame, tenant: str = "tenant_id",
                     arrival: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """W3 + A10: number new events per tenant after ``COALESCE(MAX(sequence), 0)``.

    The stored maximum is an aggregate per tenant (partial agg, small
    output) joined to the incoming rows; positions come from a chunked row
    number so a tenant with a huge burst is numbered in parallel.
    """
    arrival = arrival or ["arrival"]
    base = stored.groupBy(tenant).agg(F.max("sequence").alias("_base"))
    numbered = scan.row_number_in_order(incoming, tenant, arrival, chunk=chunk, out="_pos")
    return (numbered.join(base, tenant, "left")
                    .withColumn("sequence", F.coalesce("_base", F.lit(0)) + F.col("_pos"))
                    .drop("_base", "_pos"))


def sequence_gaps(log: DataFrame, stream: str = "stream_id", seq: str = "sequence",
                  order: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """Forward jumps per stream in arrival order.

    ``prev`` is the running maximum before the row; rows at or below it are
    replays (no gap), ``prev + 1`` is in order, anything above is a gap with
    ``(expected, observed, missing)``. The first row of a stream never gaps.
    """
    order = order or ["arrival_ts", "arrival_id"]
    d = scan.running_max_before(log, stream, order, seq, chunk=chunk, out="_prev")
    return (d.where(F.col("_prev").isNotNull() & (F.col(seq) > F.col("_prev") + 1))
             .select(stream, (F.col("_prev") + 1).alias("expected_seq"), F.col(seq).alias("observed_seq"),
                     (F.col(seq) - F.col("_prev") - 1).alias("missing_count")))


def every_nth(df: DataFrame, order: list[str], n: int, chunk: Column | None = None,
              keys: list[str] | None = None) -> DataFrame:
    """Rows whose 1-based global (or per-key) position is a multiple of ``n``.

    Global positions come from balanced range partitions plus per-partition
    offsets (``scan.global_row_number``); per-key positions from the chunked
    row number.
    """
    if not keys:
        numbered = scan.global_row_number(df, order, out="position")
    else:
        numbered = scan.row_number_in_order(df, keys, order, chunk=chunk, out="position")
    return numbered.where(F.col("position") % n == 0)


def catchup_plan(spark, ledger_seqs: DataFrame, from_ledger: int, to_ledger: int,
                 concurrency: int = DEFAULT_CONCURRENCY, max_gap: int = MAX_GAP) -> DataFrame:
    """Batches of a catch-up from ``from_ledger`` to ``to_ledger``.

    One run covers at most ``max_gap`` ledgers (the reference's rule);
    ``left_over`` says how many ledgers up to ``to_ledger`` remain for later
    runs, 0 if none. Batches of ``concurrency``
    ledgers start at ``from + 1``; a checkpoint follows a batch that crosses
    a multiple of 64 or ends the run. Ledgers not in ``ledger_seqs`` count
    as failed and are skipped; progress still advances.
    """
    target = min(to_ledger, from_ledger + max_gap)
    seqs = spark.range(from_ledger + 1, target + 1).withColumnRenamed("id", "seq")
    have = ledger_seqs.select(F.col("sequence").alias("seq")).distinct().withColumn("_have", F.lit(True))
    j = seqs.join(have, "seq", "left")
    first = from_ledger + 1
    batch = F.floor((F.col("seq") - first) / concurrency).cast("bigint")
    g = j.groupBy(batch.alias("batch_no")).agg(
        F.min("seq").alias("batch_start"), F.max("seq").alias("batch_end"),
        F.count_if(F.col("_have").isNull()).alias("failed_count"))
    crossed = F.floor(F.col("batch_end") / CHECKPOINT_INTERVAL) > F.floor((F.col("batch_start") - 1) / CHECKPOINT_INTERVAL)
    return g.select("batch_no", "batch_start", "batch_end", "failed_count",
                    F.col("batch_end").alias("last_synced_ledger"),
                    (crossed | (F.col("batch_end") == target)).alias("checkpoint"),
                    F.lit(to_ledger - target).cast("bigint").alias("left_over"))


def ledger_lag(polls: DataFrame) -> DataFrame:
    """``max(0, latest - last_synced)``; NULL before the first poll."""
    return polls.withColumn(
        "lag", F.when(F.col("latest_polled").isNull(), F.lit(None).cast("bigint"))
                .otherwise(F.greatest(F.lit(0).cast("bigint"),
                                      F.col("latest_polled") - F.coalesce("last_synced", F.lit(0)))))


def ledger_transactions(pages: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per (ledger, tx) with the tx's operation count (NULL if the
    transaction could not be fetched)."""
    tx = pages.select("sequence", F.posexplode("transactions").alias("tx_index", "tx_hash"))
    return (tx.join(transactions, "tx_hash", "left")
              .select("sequence", "tx_index", "tx_hash", F.size("operations").alias("op_count")))


def open_batches(batches: DataFrame) -> DataFrame:
    """The latest OPEN batch per device (``max_by`` on ``batch_start``)."""
    return (batches.where(F.col("state") == "OPEN")
                   .groupBy("device_id")
                   .agg(F.max_by(F.struct("id", "batch_start", "batch_end", "state"), "batch_start").alias("b"))
                   .select("device_id", "b.*"))


def batch_contiguity(batches: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Each batch against its successor: contiguous, gap or overlap."""
    d = scan.next_in_order(batches, "device_id", "batch_start", "batch_start", chunk=chunk, out="next_start")
    status = (F.when(F.col("next_start").isNull(), F.lit("last"))
               .when(F.col("next_start") == F.col("batch_end"), F.lit("contiguous"))
               .when(F.col("next_start") > F.col("batch_end"), F.lit("gap"))
               .otherwise(F.lit("overlap")))
    return d.select("device_id", "id", "batch_start", "batch_end", "next_start", status.alias("status"))


def generate_batches(first_last: DataFrame, window: str = "5 minutes") -> DataFrame:
    """W5 generation: contiguous batches from each device's first to last
    bucket, ids ``device:startEpochMs`` (successor start = predecessor end)."""
    b = first_last.select("device_id", F.explode(F.sequence("first_start", "last_start",
                                                            F.expr(f"INTERVAL {window}"))).alias("batch_start"))
    ms = F.floor(F.unix_micros(F.col("batch_start").cast("timestamp")) / 1000).cast("bigint")
    return b.select(F.concat_ws(":", "device_id", ms.cast("string")).alias("id"), "device_id", "batch_start",
                    (F.col("batch_start") + F.expr(f"INTERVAL {window}")).alias("batch_end"))

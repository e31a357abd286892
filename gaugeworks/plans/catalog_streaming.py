"""Queries: Structured Streaming operators run to completion with
``trigger(availableNow=True)`` over the driver's events file, their sink read
back. Each equals its batch twin's oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timebuckets import time_bucket
from ..session import checkpoint_root
from ..sources import tables
from ..sources.stored import set_ages
from ..streaming import rollups as srollups
from ..streaming import sinks
from .catalog_rollups import _rollup_sql
from .oracle_views import with_views
from .registry import register


def _scratch(spark, name: str) -> tuple[str, str]:
    base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


#: Rows of one arriving file, about.
FILE_ROWS = 1_000_000
#: Bytes of one arriving file before compression, about.
FILE_BYTES = 128 * 1024 * 1024


def _row_bytes(df):
    """Bytes of a row, about: the length of its texts and binaries, 8 for any other column."""
    return sum((F.coalesce(F.octet_length(f"`{n}`").cast("bigint"), F.lit(0)) if t in ("string", "binary") else F.lit(8) for n, t in df.dtypes), F.lit(0).cast("bigint"))


def arriving(df, base: str, at, files: int = 4, ties=None):
    """``df`` as a stream of several files in the order of the number ``at``.

    A file stream reads files by age. One parallel job range-partitions the rows by
    ``at`` and writes one sorted file per range; part files are named by their range,
    so setting their times in name order makes age follow arrival. There are
    ``files`` ranges at least and one per FILE_ROWS rows or FILE_BYTES bytes, so no task or
    micro-batch grows with the input; rows of equal ``at`` share a range, rows without one come
    last. Where few values of ``at`` hold many rows, ``ties`` (the key whose rows may not
    be parted, such as its hash) says how a value is cut into several ranges.
    """
    spark = df.sparkSession
    n, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    ranges = max(files, -(-n // FILE_ROWS), -(-(size or 0) // FILE_BYTES))
    order = [at.asc_nulls_last()] + ([ties] if ties is not None else [])
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(f"{base}/arrived")
    set_ages(spark, f"{base}/arrived")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrived")


def _clock(spark, sf_dir, base: str):
    """The events in order of arrival on a dense clock: a day's events fall within one second, days are two hours apart.

    So the real windows of seconds and the hour after which a state expires both matter on the
    driver's events, which are minutes apart. Adds ``time_ms`` and the event time of the watermark.
    """
    ev = arriving_events(spark, sf_dir, base)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.floor(at / 86_400_000_000)
    ms = day * 7_200_000 + F.floor((at - day * 86_400_000_000) / 86_400_000)
    return ev.withColumn("time_ms", ms.cast("bigint")).withColumn("event_time", F.timestamp_millis("time_ms")).withWatermark("event_time", "10 seconds")


CLOCK_SQL = """clock AS (
  SELECT *, (epoch_us(ts) // 86400000000) * 7200000 + (epoch_us(ts) % 86400000000) // 86400000 AS time_ms FROM events)"""


def arriving_events(spark, sf_dir, base: str, delay=0):
    """The events in order of arrival, ``delay`` seconds after their time."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) + (F.lit(delay) if isinstance(delay, int) else delay) * 1_000_000
    return arriving(tables.read_table(spark, sf_dir, "events"), base, at)


@register("stream_usage_1h", _rollup_sql("1h"))
def stream_usage_1h(spark, sf_dir):
    """Hourly rollup as a watermarked streaming aggregation over several
    micro-batches with late readings, merged into a table."""
    out, ckpt = _scratch(spark, "stream-usage-1h")
    late = F.get_json_object("props", "$.k").cast("int")
    tel = tables.telemetry_from(arriving_events(spark, sf_dir, ckpt + "-src", late))
    q = srollups.run_rollup_stream(spark, tel, "1h", out, checkpoint=ckpt)
    q.awaitTermination()
    return spark.read.parquet(out).drop("day")


@register("stream_seq_gaps", with_views("ledger") + """SELECT stream_id, prev + 1 AS expected_seq, sequence AS observed_seq,
       sequence - prev - 1 AS missing_count
FROM (SELECT *, MAX(sequence) OVER (PARTITION BY stream_id ORDER BY arrival_ts, arrival_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM ledger)
WHERE prev IS NOT NULL AND sequence > prev + 1""")
def stream_seq_gaps(spark, sf_dir):
    """Gap monitor over several micro-batches: each is scanned by the hour,
    one maximum per stream is carried, gaps go to an idempotent sink."""
    out, ckpt = _scratch(spark, "stream-gaps")
    led = tables.ledger_from(arriving_events(spark, sf_dir, ckpt + "-src"))
    sink = sinks.gap_sink(out, ckpt + "-state", chunk=time_bucket("1 hour", "arrival_ts"))
    w = led.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True)
    with sinks.batch_partitions(spark):
        q = w.start()
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_first_claims", with_views("payloads") + """SELECT nonce, arg_min(event_id, (ts_ms, event_id)) AS event_id, MIN(ts_ms) AS ts_ms
FROM payloads GROUP BY nonce""")
def stream_first_claims(spark, sf_dir):
    """At-least-once payload stream into an exactly-once sink: the first
    claim per nonce is stored once, however often a batch is replayed. The target is
    partitioned by a part of the nonce, so a batch reads the parts it touches."""
    out, ckpt = _scratch(spark, "stream-claims")
    p = tables.payloads_from(arriving_events(spark, sf_dir, ckpt + "-src")).select("nonce", "event_id", "ts_ms") \
              .withColumn("_order", F.struct("ts_ms", "event_id")).withColumn("part", F.pmod(F.xxhash64("nonce"), F.lit(16)))
    w = (p.writeStream.foreachBatch(sinks.insert_ignore_sink(out, ["part", "nonce"], order="_order", partition_by=["part"]))
          .option("checkpointLocation", ckpt).trigger(availableNow=True))
    with sinks.batch_partitions(spark):
        q = w.start()
    q.awaitTermination()
    return spark.read.parquet(out).select("nonce", "event_id", "ts_ms")

"""Streaming rollups with late data (R1), adaptive refresh (R2) and the 60 s
counter flush (R10).

R1 keeps one aggregation state per (window, device) in the state store;
``withWatermark(time, start_offset)`` bounds how late a reading may arrive
and lets Spark drop finished windows from state. Each micro-batch emits the
updated windows (``update`` mode) and ``merge_rollup`` replaces those rows
in the rollup table. R2 recomputes touched buckets from the stored raw
readings instead, for data older than the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import RESOLUTIONS, time_bucket
from ..operators.rollups import POLICIES, _finalize, _state_aggs, billing_aggs, rollup_from_state, rollup_state
from ..session import checkpoint_root
from ..sources.stored import epochs, finished, read_epoch, read_if_exists, remove, write_epoch
from .sinks import batch_partitions

# ``window`` buckets follow the epoch (a Thursday); 4 days moves weeks to Monday.
_WINDOW_START = {"1w": "4 days"}


def windowed_state(stream: DataFrame, resolution: str, watermark: str | None = None) -> DataFrame:
    """Tumbling-window rollup state ``(bucket, device_id, count, sum, min, max, watermark)`` of a telemetry stream."""
    if resolution == "1mo":
        raise ValueError("monthly buckets are derived from the daily rollup (A7)")
    width = RESOLUTIONS[resolution]
    wm = watermark or POLICIES[resolution][0]
    t = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", wm)
    w = F.window("time", width, startTime=_WINDOW_START.get(resolution)) if resolution in _WINDOW_START \
        else F.window("time", width)
    g = t.groupBy(w.alias("w"), "device_id").agg(*_state_aggs())
    return g.withColumn("bucket", F.col("w.start").cast("timestamp_ntz")).drop("w") \
            .withColumn("_aggregate_watermark", F.col("_aggregate_watermark").cast("timestamp_ntz"))


def windowed_rollup(stream: DataFrame, resolution: str, watermark: str | None = None) -> DataFrame:
    """Tumbling-window device rollup over a telemetry stream.

    ``watermark`` defaults to the view's refresh ``start_offset``. Months
    have no fixed width, so the monthly view is derived from the daily state
    (:func:`month_sink`).
    """
    return _finalize(windowed_state(stream, resolution, watermark), ["bucket", "device_id"])


def windowed_billing(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """R1 for the billing view: one row per (day, account, device) over a stream of billing records."""
    t = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", watermark or POLICIES["billing_1d"][0])
    g = t.groupBy(F.window("time", "1 day").alias("w"), "account_id", "device_id").agg(*billing_aggs())
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "account_id", "device_id", "total_usage", "transaction_count", "settled_count",
                    "failed_count", F.col("_aggregate_watermark").cast("timestamp_ntz").alias("_aggregate_watermark"))


def _replace_days(spark: SparkSession, path: str, merged: DataFrame, journal: str, epoch_id) -> None:
    """Overwrite the day partitions of ``merged`` with a journal for recovery.

    The rows are first committed to ``journal``; a crash while partitions are
    being replaced leaves them there, and the replay puts them in place again
    instead of merging with a half-replaced table.
    """
    entry = f"{journal}/epoch={epoch_id}"
    if not finished(spark, entry):
        merged.write.mode("overwrite").parquet(entry)
    (spark.read.schema(merged.schema).parquet(entry).write.mode("overwrite")
          .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    remove(spark, entry)


def merge_rollup(path: str, keys=("bucket", "device_id"), chunk: str = "day"):
    """``foreachBatch`` sink replacing rows by key in a table partitioned by ``day``.

    With ``chunk="month"`` a partition holds a month and ``day`` is its first day: coarse
    views have few rows a day. Only the partitions present in the micro-batch are rewritten
    (dynamic partition overwrite), and only they are read: a semi join on
    the batch's days, which Spark prunes dynamically. The merged rows go through
    a journal (:func:`_replace_days`), so the job neither reads and overwrites
    the same files in one plan nor loses rows in a crash. Replaying an epoch
    writes the same rows again, so the sink is idempotent.
    """
    keys = list(keys)

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("bucket") if chunk == "day" else F.trunc(F.to_date("bucket"), chunk))
        merged = new
        old = read_if_exists(spark, path)
        if old is not None:
            touched = old.join(new.select("day").distinct(), "day", "left_semi")
            merged = touched.join(new.select(*keys), keys, "left_anti").unionByName(new)
        _replace_days(spark, path, merged, f"{path.rstrip('/')}-journal", epoch_id)

    return write


#: Bucket width and partition of the stored table per view.
_VIEWS = {"15m": ("15 minutes", "day"), "1h": ("1 hour", "day"), "1d": ("1 day", "month"), "1w": ("7 days", "month"), "1mo": ("1 month", "year"),
          "billing_1d": ("1 day", "month")}


def policy_sink(path: str, view: str, keys=("bucket", "device_id")):
    """``foreachBatch`` sink with both ends of a view's refresh policy, for updated rows of a rollup stream.

    The clock is the latest event time seen. A bucket appears in the table at ``path`` once it has been
    closed for ``end_offset``; until then its row waits in a pending table, which holds the buckets of the
    last ``end_offset`` only. After that every update corrects it, until the stream's watermark
    (``start_offset``) drops late rows. Pending rows and clock are a folder per epoch, so a replayed
    epoch starts from the same state and merges the same rows.
    """
    keys = list(keys)
    width, chunk = _VIEWS[view]
    end_offset = POLICIES[view][1]
    pending, clock = f"{path.rstrip('/')}-pending", f"{path.rstrip('/')}-clock"
    merge = merge_rollup(path, keys, chunk)

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            now = batch.agg(F.max("_aggregate_watermark").alias("now"))
            told = read_epoch(spark, clock, before=epoch_id)
            write_epoch(now if told is None else now.unionByName(told).agg(F.max("now").alias("now")), clock, epoch_id)
            at = read_epoch(spark, clock, before=epoch_id + 1).first()["now"]
            rows, old = batch, read_epoch(spark, pending, before=epoch_id)
            if old is not None:
                waiting = old.where("not due").drop("due")
                rows = waiting.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
            closed = F.col("bucket") + F.expr(f"INTERVAL '{width}'") + F.expr(f"INTERVAL '{end_offset}'")
            write_epoch(rows.withColumn("due", F.coalesce(closed.cast("timestamp_ntz") <= F.lit(at).cast("timestamp_ntz"), F.lit(False))), pending, epoch_id)
        finally:
            batch.unpersist()
        merge(read_epoch(spark, pending, before=epoch_id + 1).where("due").drop("due"), epoch_id)

    return write


def month_sink(path: str, state_path: str):
    """``foreachBatch`` sink of the monthly view, chained behind daily rollup state (:func:`windowed_state`).

    Daily state is merged by key first; the calendar months it touches are then summed again from their stored
    days (at most 31 rows per device, pruned by month) and go through the monthly policy.
    """
    daily, monthly = merge_rollup(state_path, chunk="month"), policy_sink(path, "1mo")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            daily(batch, epoch_id)
            stored = read_if_exists(spark, state_path)
            if stored is None:
                return
            touched = batch.select(F.trunc(F.to_date("bucket"), "month").alias("day"), "device_id").distinct()
            state = rollup_from_state(stored.join(touched, ["day", "device_id"], "left_semi"), "1mo")
            monthly(_finalize(state, ["bucket", "device_id"]), epoch_id)
        finally:
            batch.unpersist()

    return write


def run_policy_stream(spark: SparkSession, stream: DataFrame, view: str, out_path: str, checkpoint: str | None = None,
                      available_now: bool = True):
    """R1 with its policy: start the stream of ``view`` (15m, 1h, 1d, 1w, 1mo or billing_1d) into ``out_path``."""
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/policy-{view}-{uuid.uuid4().hex}"
    if view == "billing_1d":
        rows, sink = windowed_billing(stream), policy_sink(out_path, view, ("bucket", "account_id", "device_id"))
    elif view == "1mo":
        rows, sink = windowed_state(stream, "1d", POLICIES["1mo"][0]), month_sink(out_path, f"{out_path.rstrip('/')}-daily")
    else:
        rows, sink = windowed_rollup(stream, view), policy_sink(out_path, view)
    q = rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    with batch_partitions(spark):
        return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")).start()


def run_rollup_stream(spark: SparkSession, stream: DataFrame, resolution: str, out_path: str,
                      checkpoint: str | None = None, watermark: str | None = None, available_now: bool = True):
    """Start R1 into ``out_path``; returns the StreamingQuery."""
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/rollup-{resolution}-{uuid.uuid4().hex}"
    q = (windowed_rollup(stream, resolution, watermark).writeStream
         .outputMode("update")
         .foreachBatch(merge_rollup(out_path))
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    with batch_partitions(spark):
        return q.start()


def counter_flush(stream: DataFrame, labels, watermark: str = "2 minutes", period: str = "60 seconds") -> DataFrame:
    """Per-label counts flushed every 60 s of event time (A14 streaming)."""
    t = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", watermark)
    return (t.groupBy(F.window("time", period).alias("w"), *labels).agg(F.count(F.lit(1)).alias("increments"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("flush_minute"), *labels, "increments"))


# --------------------------------------------------------------------------- R2 adaptive refresh


def _floor(t, res: str):
    """Bucket start of a Python datetime (Monday weeks, calendar months)."""
    from datetime import timedelta
    if res == "15m":
        return t.replace(minute=t.minute - t.minute % 15, second=0, microsecond=0)
    if res == "1h":
        return t.replace(minute=0, second=0, microsecond=0)
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if res == "1d":
        return day
    if res == "1w":
        return day - timedelta(days=day.weekday())
    return day.replace(day=1)


def _next(t, res: str):
    from datetime import timedelta
    if res == "1mo":
        return t.replace(year=t.year + (t.month == 12), month=t.month % 12 + 1)
    return t + {"15m": timedelta(minutes=15), "1h": timedelta(hours=1), "1d": timedelta(days=1),
                "1w": timedelta(days=7)}[res]


def refresh_from_raw(spark: SparkSession, raw_path: str, rollup_paths: dict, batch: DataFrame | None,
                     now, retention_days: int = 365, margin_days: int = 5, bounds: tuple | None = None) -> dict:
    """R2 for one micro-batch of newly stored readings.

    For each view: the touched range is ``[bucket(min time), bucket(max
    time) + 1 bucket)`` (A9), clamped to the retention-safe boundary (F12)
    and then rounded up to a bucket edge, so no bucket is rebuilt from part
    of its rows. Buckets in the range are recomputed from the raw table
    (pruned to the range) and replace the stored ones; only the day
    partitions of the range are read and rewritten.
    """
    from datetime import timedelta
    if bounds is not None:
        mn, mx = bounds
    else:
        mm = batch.agg(F.min("time").alias("mn"), F.max("time").alias("mx")).first()
        mn, mx = (mm["mn"], mm["mx"]) if mm is not None else (None, None)
    if mn is None:
        return {}
    boundary = now - timedelta(days=retention_days - margin_days)
    done = {}
    raw = spark.read.parquet(raw_path)
    for res, path in rollup_paths.items():
        start, end = _floor(mn, res), _next(_floor(mx, res), res)
        if start < boundary:
            edge = _floor(boundary, res)
            start = edge if edge == boundary else _next(edge, res)
        if start >= end:
            continue
        s_lit, e_lit = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        rows = raw.where((F.col("time") >= s_lit) & (F.col("time") < e_lit))
        fresh = _finalize(rollup_state(rows, res), ["bucket", "device_id"]).withColumn("day", F.to_date("bucket"))
        days = [start.date(), (end - timedelta(microseconds=1)).date()]  # first and last day of the range
        old = read_if_exists(spark, path)
        if old is not None:
            in_days = (F.col("day") >= F.lit(min(days))) & (F.col("day") <= F.lit(max(days)))
            keep = old.where(in_days & ((F.col("bucket") < s_lit) | (F.col("bucket") >= e_lit)))
            fresh = keep.unionByName(fresh)
        _replace_days(spark, path, fresh, f"{path.rstrip('/')}-journal", f"{start:%Y%m%d%H%M}-{end:%Y%m%d%H%M}")
        done[res] = (start, end)
    return done


# --------------------------------------------------------------------------- R3 refresh every N inserts


def ingest_with_refresh(raw_path: str, rollup_paths: dict, counter_path: str, every: int = 10_000,
                        now=None, retention_days: int = 365, margin_days: int = 5):
    """R3 + R2 as one ``foreachBatch`` writer.

    Each micro-batch is appended to the raw store (S2); a counter row per
    epoch keeps the running insert count and the time range touched since
    the last refresh, and the newest committed epoch is the state. When the count crosses a multiple of ``every`` the
    touched range is refreshed from the raw store (R2) and the range resets.
    The raw rows of an epoch go to their own folder (overwritten when the
    epoch is replayed) and the counter skips epochs it already counted, so a
    replay changes nothing.
    """
    from ..sources.telemetry_store import write_telemetry

    def write(batch: DataFrame, epoch_id: int) -> None:
        import datetime as dt
        spark = batch.sparkSession
        if epoch_id in epochs(spark, counter_path):
            return  # this epoch was already applied
        state = read_epoch(spark, counter_path, before=epoch_id)
        c = state.first() if state is not None else None
        total = c["total"] if c is not None else 0
        lo = c["pending_min"] if c is not None else None
        hi = c["pending_max"] if c is not None else None
        stats = batch.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("mn"), F.max("time").alias("mx")).first()
        if stats["n"] == 0:
            return
        # One folder per epoch, overwritten if the epoch is replayed: idempotent.
        write_telemetry(batch, f"{raw_path}/epoch={epoch_id}", mode="overwrite")
        lo = stats["mn"] if lo is None else min(lo, stats["mn"])
        hi = stats["mx"] if hi is None else max(hi, stats["mx"])
        refreshed = False
        if (total + stats["n"]) // every > total // every:
            refresh_from_raw(spark, raw_path, rollup_paths, None, now or dt.datetime.utcnow(),
                             retention_days, margin_days, bounds=(lo, hi))
            lo = hi = None
            refreshed = True
        row = spark.createDataFrame([(epoch_id, total + stats["n"], lo, hi, refreshed)],
                                    "epoch_id long, total long, pending_min timestamp_ntz, pending_max timestamp_ntz, refreshed boolean")
        write_epoch(row.coalesce(1), counter_path, epoch_id)

    return write

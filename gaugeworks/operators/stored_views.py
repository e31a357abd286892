"""Rollup views as stored tables with a real-time tail.

The five views are kept as mergeable state in one table, partitioned by resolution and
by day (15 minutes, hour) or month (coarser views). A view holds the buckets that are
closed for its ``end_offset``; the first bucket it does not hold is its watermark. A read takes
the stored buckets below the watermark and computes the rest: of the 15-minute view from
raw readings, of every coarser view from the next finer view, so readings are
scanned from the 15-minute watermark on only, however far back a month reaches.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import time_bucket
from ..sources.stored import read_epoch, write_epoch
from .rollups import POLICIES, _finalize, rollup_from_state, rollup_state

#: The finer view that a view's tail is summed from.
FINER = {"1h": "15m", "1d": "1h", "1w": "1d", "1mo": "1d"}
VIEWS = ["15m", *FINER]
STATE = ("bucket timestamp_ntz, device_id string, sample_count bigint, sum_value decimal(38,2), min_value decimal(18,2), max_value decimal(18,2), "
         "_aggregate_watermark timestamp_ntz")
_STORED = f"{STATE}, resolution string, day date"


def watermark(resolution: str, now: datetime) -> Column:
    """Start of the first bucket that is not closed for the view's ``end_offset`` at ``now`` (a constant for the optimizer)."""
    return time_bucket(resolution, F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{POLICIES[resolution][1]}'"))


def _partition(resolution: str, bucket: Column) -> Column:
    """The ``day`` of a bucket's partition: coarse views have few rows a day, so theirs is the month's first."""
    day = F.to_date(bucket)
    return day if resolution in ("15m", "1h") else F.trunc(day, "month")


def _below(resolution: str, limit: Column) -> Column:
    return (F.col("bucket") < limit) & (F.col("day") <= _partition(resolution, limit))


def refreshed_at(spark: SparkSession, path: str) -> datetime | None:
    """The time as of which the stored views are closed, None before the first refresh."""
    clock = read_epoch(spark, f"{path.rstrip('/')}-clock")
    return clock.first()["now"] if clock is not None else None


def store_views(telemetry: DataFrame, path: str, now: datetime) -> None:
    """Bring the stored views to ``now``: add the buckets closed since the last refresh, all of them the first time.

    Whole partitions are rewritten, from the first day of the month that holds the earliest bucket not stored yet, so
    older readings are not scanned. The views become readable at ``now`` by one small clock write after the table;
    a crash before it leaves the old watermarks, below which nothing has changed.
    """
    spark = telemetry.sparkSession
    last, tel = refreshed_at(spark, path), telemetry
    start = None
    if last is not None:
        start = F.date_trunc("month", F.least(*[watermark(r, last) for r in VIEWS])).cast("timestamp_ntz")
        tel = telemetry.where(F.col("time") >= start)
    def closed(state: DataFrame, res: str) -> DataFrame:
        part = state.withColumn("sum_value", F.col("sum_value").cast("decimal(38,2)")).where(F.col("bucket") < watermark(res, now))
        if start is not None:  # a week that began before the month was closed then
            part = part.where(F.col("bucket") >= start)
        return part.withColumn("resolution", F.lit(res)).withColumn("day", _partition(res, F.col("bucket")))

    def write(rows: DataFrame) -> None:
        rows.repartition("resolution", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resolution", "day").parquet(path)

    # readings are scanned once; a closed bucket of a coarser view is made of closed buckets of the finest
    write(closed(rollup_state(tel, "15m"), "15m"))
    finest = stored(spark, path).where(F.col("resolution") == "15m")
    if start is not None:
        finest = finest.where((F.col("bucket") >= start) & (F.col("day") >= F.to_date(start)))
    # one aggregate for the four coarser views: every finest bucket counts in one bucket of each, combined before the shuffle
    at = F.explode(F.array(*[F.struct(F.lit(r).alias("resolution"), time_bucket(r, "bucket").alias("to")) for r in FINER])).alias("v")
    spread = finest.select("device_id", "sample_count", "sum_value", "min_value", "max_value", "_aggregate_watermark", at)
    coarse = spread.groupBy("v.resolution", F.col("v.to").alias("bucket"), "device_id").agg(
        F.sum("sample_count").alias("sample_count"), F.sum("sum_value").cast("decimal(38,2)").alias("sum_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.max("_aggregate_watermark").alias("_aggregate_watermark"))
    limit = day = None
    for r in FINER:
        limit = F.when(F.col("resolution") == r, watermark(r, now)) if limit is None else limit.when(F.col("resolution") == r, watermark(r, now))
        part = _partition(r, F.col("bucket"))
        day = F.when(F.col("resolution") == r, part) if day is None else day.when(F.col("resolution") == r, part)
    coarse = coarse.where(F.col("bucket") < limit)
    if start is not None:
        coarse = coarse.where(F.col("bucket") >= start)
    write(coarse.withColumn("day", day))
    clock = spark.range(1).select(F.lit(now).cast("timestamp_ntz").alias("now"))
    write_epoch(clock.coalesce(1), f"{path.rstrip('/')}-clock", int(now.timestamp() * 1000))


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def live_views(spark: SparkSession, path: str, telemetry: DataFrame) -> dict[str, DataFrame]:
    """State of the five views: stored buckets below each watermark, the tail summed from the finer view above it."""
    table, views, now = stored(spark, path), {}, refreshed_at(spark, path)
    for res in VIEWS:
        limit = watermark(res, now)
        if res in FINER:
            tail = rollup_from_state(views[FINER[res]].where(F.col("bucket") >= limit), res)
        else:
            tail = rollup_state(telemetry.where(F.col("time") >= limit), res)
        old = table.where(F.col("resolution") == res).where(_below(res, limit)).drop("resolution", "day")
        views[res] = old.unionByName(tail.select(*old.columns))
    return views


def read_range(views: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """P2+P3 for many requests ``(request_id, device_id, start, end)``: closed ``[start, end]`` on the bucket of the view each span picks.

    Requests are joined once, on view and device; invalid requests (start after end) return no rows.
    """
    from .analytics import resolution_expr

    req = requests.withColumn("view_used", resolution_expr(F.col("start"), F.col("end"))).where(F.col("view_used").isNotNull())
    rows = None
    for res, view in views.items():
        part = view.withColumn("view_used", F.lit(res))
        rows = part if rows is None else rows.unionByName(part)
    hits = rows.join(req, ["view_used", "device_id"]).where((F.col("bucket") >= F.col("start")) & (F.col("bucket") <= F.col("end")))
    return _finalize(hits, ["request_id", "view_used", "bucket", "device_id"])

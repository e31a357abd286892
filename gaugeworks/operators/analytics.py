"""Range reads: raw device range (P1), multi-resolution analytics (P2, P3),
keyset paging (P4).

Single requests are answered from materialized rollup tables: the filter on
``device_id`` and ``bucket`` reaches the Parquet scan of the chosen table. A
batch of requests (one row per request) is answered in one pass over raw
readings: readings are joined to requests on ``device_id`` (AQE picks a
broadcast when the request table is small and splits skewed devices
otherwise), bucketed at each request's resolution, and aggregated once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timebuckets import RESOLUTIONS, time_bucket
from .rollups import _finalize, _state_aggs

# Resolution thresholds in days (inclusive), smallest first.
RESOLUTION_THRESHOLDS = [(0.25, "15m"), (3.0, "1h"), (30.0, "1d"), (120.0, "1w")]
COARSEST = "1mo"

ANALYTICS_COLUMNS = ["bucket", "deviceId", "sampleCount", "totalValue", "avgValue",
                     "minValue", "maxValue", "aggregateWatermark"]


class BadRequest(ValueError):
    """Invalid analytics request (unparseable date, start after end)."""


def _parse(ts: str | datetime) -> datetime:
    if isinstance(ts, datetime):
        return ts
    try:
        return datetime.fromisoformat(ts.replace("Z", "+00:00")).replace(tzinfo=None)
    except (AttributeError, ValueError) as exc:
        raise BadRequest(f"Invalid start or end date format: {ts!r}") from exc


def pick_resolution(start: str | datetime, end: str | datetime) -> tuple[str, float]:
    """P3 on the driver: choose the smallest rollup covering ``[start, end]``."""
    s, e = _parse(start), _parse(end)
    if s > e:
        raise BadRequest("Start date must be before end date")
    days = (e - s).total_seconds() / 86400.0
    for limit, res in RESOLUTION_THRESHOLDS:
        if days <= limit:
            return res, days
    return COARSEST, days


def range_days(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)


def resolution_expr(start: Column, end: Column) -> Column:
    """P3 as a column: NULL for an invalid request (start after end or NULL)."""
    days = range_days(start, end)
    expr = F.when(start.isNull() | end.isNull() | (start > end), F.lit(None).cast("string"))
    for limit, res in RESOLUTION_THRESHOLDS:
        expr = expr.when(days <= limit, F.lit(res))
    return expr.otherwise(F.lit(COARSEST))


def raw_range(telemetry: DataFrame, device_id: str, start: str, end: str) -> DataFrame:
    """Readings of one device in ``[start, end)`` ordered by time."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (telemetry.where((F.col("device_id") == device_id) & (F.col("time") >= s) & (F.col("time") < e))
                     .select("device_id", "metric_id", "metric_value", "time")
                     .orderBy("time"))


def analytics_range(rollups: dict[str, DataFrame], device_id: str, start: str, end: str) -> tuple[str, DataFrame]:
    """P2 for one request against materialized rollups: closed ``[start, end]`` on bucket."""
    res, _ = pick_resolution(start, end)
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    view = rollups[res]
    out = (view.where((F.col("device_id") == device_id) & (F.col("bucket") >= s) & (F.col("bucket") <= e))
               .select(F.col("bucket"), F.col("device_id").alias("deviceId"),
                       F.col("sample_count").alias("sampleCount"), F.col("total_value").alias("totalValue"),
                       F.col("avg_value").alias("avgValue"), F.col("min_value").alias("minValue"),
                       F.col("max_value").alias("maxValue"),
                       F.col("_aggregate_watermark").alias("aggregateWatermark"))
               .orderBy("bucket"))
    return res, out


def analytics_batch(rollups: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """P2+P3 for many requests ``(request_id, device_id, start, end)`` against the rollup views.

    Each request is answered from the one view its span picks, by an equi-join
    on the device and the closed range ``[start, end]`` on the bucket; raw
    readings are not touched. Buckets are whole: the last one may hold readings
    after ``end``. Invalid requests (start after end) return no rows.
    """
    req = requests.withColumn("view_used", resolution_expr(F.col("start"), F.col("end"))).where(F.col("view_used").isNotNull())
    out = None
    for res, view in rollups.items():
        mine = req.where(F.col("view_used") == res)
        rows = view.join(mine, "device_id").where((F.col("bucket") >= F.col("start")) & (F.col("bucket") <= F.col("end")))
        rows = rows.select("request_id", "view_used", *view.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def event_page(events: DataFrame, tenant_id: str, after_seq: int = 0, limit: int = 100) -> DataFrame:
    """Keyset page ``sequence > after`` ascending, at most ``limit`` rows (TakeOrdered)."""
    return (events.where((F.col("tenant_id") == tenant_id) & (F.col("sequence") > after_seq))
                  .orderBy("sequence").limit(limit))


def event_pages(events: DataFrame, after: DataFrame, limit: int = 100) -> DataFrame:
    """P4 for many tenants at once: ``after`` holds ``(tenant_id, after_seq)``.

    A per-tenant top-``limit`` by ``row_number`` over rows past the cursor.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("tenant_id").orderBy("sequence")
    return (events.join(after, "tenant_id")
                  .where(F.col("sequence") > F.col("after_seq"))
                  .withColumn("page_pos", F.row_number().over(w))
                  .where(F.col("page_pos") <= limit)
                  .drop("after_seq"))

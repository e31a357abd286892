"""Queries: telemetry scans, device rollups, range reads, compaction."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.timebuckets import time_bucket
from ..operators import analytics, rollups, stored_views
from ..session import checkpoint_root
from ..sources import tables
from .oracle_views import with_views
from .registry import register

# --------------------------------------------------------------------------- sql fragments

_ROLLUP_SELECT = """COUNT(*) AS sample_count,
       CAST(SUM(metric_value) AS DOUBLE) AS total_value,
       CAST(SUM(metric_value) AS DOUBLE) / COUNT(*) AS avg_value,
       CAST(MIN(metric_value) AS DOUBLE) AS min_value,
       CAST(MAX(metric_value) AS DOUBLE) AS max_value,
       MAX(time) AS _aggregate_watermark"""

_BUCKET_SQL = {
    "15m": "time_bucket(INTERVAL 15 MINUTE, {t})",
    "1h": "date_trunc('hour', {t})",
    "1d": "date_trunc('day', {t})",
    "1w": "date_trunc('week', {t})",
    "1mo": "date_trunc('month', {t})",
}


def _rollup_sql(res: str) -> str:
    b = _BUCKET_SQL[res].format(t="time")
    return with_views("telemetry") + f"""SELECT {b} AS bucket, device_id,
       {_ROLLUP_SELECT}
FROM telemetry GROUP BY 1, 2"""


# Request spans by user_id % 5: 5 hours, 2, 19, 111 and 365 days.
_SPANS = [(0, 5, 0), (1, 0, 2), (2, 0, 19), (3, 0, 111), (4, 0, 365)]


def _requests(tel: DataFrame) -> DataFrame:
    """One range request per device, derived from the device's first reading."""
    first = tel.groupBy("device_id", "user_id").agg(F.min("time").alias("first_time"))
    start = (time_bucket("1 hour", "first_time") + F.expr("INTERVAL 7 MINUTES")).cast("timestamp_ntz")
    span = None
    for mod, hours, days in _SPANS:
        iv = F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))
        span = F.when(F.col("user_id") % 5 == mod, iv) if span is None else span.when(F.col("user_id") % 5 == mod, iv)
    return first.select(F.col("device_id").alias("request_id"), "device_id",
                        start.alias("start"), (start + span).cast("timestamp_ntz").alias("end"))


_REQUESTS_SQL = """requests AS (
  SELECT device_id AS request_id, device_id,
         date_trunc('hour', MIN(time)) + INTERVAL 7 MINUTE AS start,
         date_trunc('hour', MIN(time)) + INTERVAL 7 MINUTE + CASE user_id % 5
             WHEN 0 THEN INTERVAL 5 HOUR WHEN 1 THEN INTERVAL 2 DAY WHEN 2 THEN INTERVAL 19 DAY
             WHEN 3 THEN INTERVAL 111 DAY ELSE INTERVAL 365 DAY END AS "end"
  FROM telemetry GROUP BY device_id, user_id)"""

_VIEW_SQL = """CASE WHEN start IS NULL OR "end" IS NULL OR start > "end" THEN NULL
            WHEN (epoch_us("end") - epoch_us(start)) / 86400000000.0 <= 0.25 THEN '15m'
            WHEN (epoch_us("end") - epoch_us(start)) / 86400000000.0 <= 3 THEN '1h'
            WHEN (epoch_us("end") - epoch_us(start)) / 86400000000.0 <= 30 THEN '1d'
            WHEN (epoch_us("end") - epoch_us(start)) / 86400000000.0 <= 120 THEN '1w'
            ELSE '1mo' END"""

# --------------------------------------------------------------------------- scans


@register("telemetry_scan", with_views("telemetry") + """SELECT time, device_id, metric_id, metric_value,
       COALESCE(region, 'default') AS region, CAST(time AS DATE) AS day, ingested_at
FROM telemetry""")
def telemetry_scan(spark, sf_dir):
    """The telemetry table with its partition column ``day``."""
    t = tables.telemetry(spark, sf_dir)
    return t.select("time", "device_id", "metric_id", "metric_value",
                    F.coalesce("region", F.lit("default")).alias("region"),
                    F.to_date("time").alias("day"), "ingested_at")


@register("retention_keep", with_views("telemetry") + """SELECT time, device_id, metric_id, metric_value
FROM telemetry
WHERE CAST(time AS DATE) >= CAST(TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY AS DATE)""")
def retention_keep(spark, sf_dir):
    """Keep rows whose day is inside the retention period (20 days before 2024-01-31)."""
    from ..sources.telemetry_store import retention_filter
    t = tables.telemetry(spark, sf_dir)
    return retention_filter(t, now="2024-01-31 00:00:00", retention_days=20).select(
        "time", "device_id", "metric_id", "metric_value")


# --------------------------------------------------------------------------- rollups

for _res in ("15m", "1h", "1d", "1w", "1mo"):
    def _make(res):
        def q(spark, sf_dir):
            return rollups.device_rollup(tables.telemetry(spark, sf_dir), res)
        q.__name__ = f"usage_{res}"
        q.__doc__ = f"A1-A5: {res} device rollup."
        return q
    register(f"usage_{_res}", _rollup_sql(_res), bench=_res in ("15m", "1h"))(_make(_res))


@register("usage_rollup_chain", with_views("telemetry", extra=f"""
s15 AS (SELECT {_BUCKET_SQL['15m'].format(t='time')} AS bucket, device_id, COUNT(*) AS n,
               SUM(metric_value) AS s, MIN(metric_value) AS mn, MAX(metric_value) AS mx, MAX(time) AS wm
        FROM telemetry GROUP BY 1, 2),
s1h AS (SELECT date_trunc('hour', bucket) AS bucket, device_id, SUM(n) AS n, SUM(s) AS s, MIN(mn) AS mn,
               MAX(mx) AS mx, MAX(wm) AS wm FROM s15 GROUP BY 1, 2),
s1d AS (SELECT date_trunc('day', bucket) AS bucket, device_id, SUM(n) AS n, SUM(s) AS s, MIN(mn) AS mn,
               MAX(mx) AS mx, MAX(wm) AS wm FROM s1h GROUP BY 1, 2),
s1w AS (SELECT date_trunc('week', bucket) AS bucket, device_id, SUM(n) AS n, SUM(s) AS s, MIN(mn) AS mn,
               MAX(mx) AS mx, MAX(wm) AS wm FROM s1d GROUP BY 1, 2),
s1mo AS (SELECT date_trunc('month', bucket) AS bucket, device_id, SUM(n) AS n, SUM(s) AS s, MIN(mn) AS mn,
               MAX(mx) AS mx, MAX(wm) AS wm FROM s1d GROUP BY 1, 2),
allr AS (SELECT '15m' AS resolution, * FROM s15 UNION ALL SELECT '1h', * FROM s1h UNION ALL
         SELECT '1d', * FROM s1d UNION ALL SELECT '1w', * FROM s1w UNION ALL SELECT '1mo', * FROM s1mo)
""") + """SELECT resolution, bucket, device_id, CAST(n AS BIGINT) AS sample_count, CAST(s AS DOUBLE) AS total_value,
       CAST(s AS DOUBLE) / n AS avg_value, CAST(mn AS DOUBLE) AS min_value, CAST(mx AS DOUBLE) AS max_value,
       wm AS _aggregate_watermark
FROM allr""")
def usage_rollup_chain(spark, sf_dir):
    """Every resolution derived from the next finer one."""
    chain = rollups.rollup_chain(tables.telemetry(spark, sf_dir))
    out = None
    for res, df in chain.items():
        df = df.select(F.lit(res).alias("resolution"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


@register("billing_daily", with_views("billing_records") + """SELECT date_trunc('day', time) AS bucket, account_id, device_id,
       CAST(SUM(usage_amount) AS BIGINT) AS total_usage, COUNT(*) AS transaction_count,
       COUNT(*) FILTER (WHERE status = 'settled') AS settled_count,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed_count,
       MAX(time) AS _aggregate_watermark
FROM billing_records GROUP BY 1, 2, 3""", bench=True)
def billing_daily(spark, sf_dir):
    """Daily billing summary."""
    return rollups.billing_daily(tables.billing_records(spark, sf_dir))


@register("batch_compact", with_views("telemetry") + """SELECT device_id || ':' || CAST((epoch_us(time) // 1000) - (epoch_us(time) // 1000) % 300000 AS VARCHAR) AS batch_id,
       device_id, metric_id,
       make_timestamp(((epoch_us(time) // 1000) - (epoch_us(time) // 1000) % 300000) * 1000) AS batch_start,
       make_timestamp(((epoch_us(time) // 1000) - (epoch_us(time) // 1000) % 300000) * 1000) + INTERVAL 300 SECOND AS batch_end,
       CAST(MIN(metric_value) AS DOUBLE) AS min_value, CAST(MAX(metric_value) AS DOUBLE) AS max_value,
       CAST(SUM(metric_value) AS DOUBLE) / COUNT(*) AS avg_value, CAST(SUM(metric_value) AS DOUBLE) AS sum_value,
       COUNT(*) AS event_count
FROM telemetry GROUP BY device_id, (epoch_us(time) // 1000) - (epoch_us(time) // 1000) % 300000, metric_id""", bench=True)
def batch_compact(spark, sf_dir):
    """Five-minute per-device per-metric summaries."""
    return rollups.batch_compact(tables.telemetry(spark, sf_dir))


@register("refresh_bounds", with_views("telemetry", extra="""
mm AS (SELECT MIN(time) AS mn, MAX(time) AS mx, COUNT(*) AS rows_since FROM telemetry
       WHERE ingested_at >= TIMESTAMP '2024-01-15 00:00:00')""") + """
SELECT '15m' AS resolution, rows_since, time_bucket(INTERVAL 15 MINUTE, mn) AS range_start,
       time_bucket(INTERVAL 15 MINUTE, mx) + INTERVAL 15 MINUTE AS range_end FROM mm
UNION ALL SELECT '1h', rows_since, date_trunc('hour', mn), date_trunc('hour', mx) + INTERVAL 1 HOUR FROM mm
UNION ALL SELECT '1d', rows_since, date_trunc('day', mn), date_trunc('day', mx) + INTERVAL 1 DAY FROM mm
UNION ALL SELECT '1w', rows_since, date_trunc('week', mn), date_trunc('week', mx) + INTERVAL 7 DAY FROM mm
UNION ALL SELECT '1mo', rows_since, date_trunc('month', mn), date_trunc('month', mx) + INTERVAL 1 MONTH FROM mm""")
def refresh_bounds(spark, sf_dir):
    """Aligned refresh bounds for rows ingested since 2024-01-15."""
    return rollups.refresh_bounds(tables.telemetry(spark, sf_dir), "2024-01-15 00:00:00")


# --------------------------------------------------------------------------- range reads


@register("raw_range", with_views("telemetry", extra=_REQUESTS_SQL) + """SELECT r.request_id, t.device_id, t.metric_id, t.metric_value, t.time
FROM telemetry t JOIN requests r ON t.device_id = r.device_id
WHERE t.time >= r.start AND t.time < r."end\"""")
def raw_range(spark, sf_dir):
    """P1 for one request per device: readings in ``[start, end)``."""
    tel = tables.telemetry(spark, sf_dir)
    req = _requests(tel)
    return (tel.select("device_id", "metric_id", "metric_value", "time")
               .join(req, "device_id")
               .where((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end")))
               .select("request_id", "device_id", "metric_id", "metric_value", "time"))


@register("raw_range_ordered", with_views("telemetry", extra=_REQUESTS_SQL) + """SELECT r.request_id, row_number() OVER (PARTITION BY r.request_id ORDER BY t.time, t.event_id) AS place,
       t.event_id, t.metric_id, t.metric_value, t.time
FROM telemetry t JOIN requests r ON t.device_id = r.device_id WHERE t.time >= r.start AND t.time < r."end" """)
def raw_range_ordered(spark, sf_dir):
    """The readings of every request in order of time, with their places (counted in daily chunks), sorted by range partitions."""
    tel = tables.telemetry(spark, sf_dir).select("event_id", "device_id", "metric_id", "metric_value", "time")
    rows = tel.join(_requests(tables.telemetry(spark, sf_dir)), "device_id") \
        .where((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end"))).select("request_id", "event_id", "metric_id", "metric_value", "time")
    placed = scan.row_number_in_order(rows, "request_id", ["time", "event_id"], chunk=time_bucket("1 day", "time"), out="place")
    return placed.select("request_id", "place", "event_id", "metric_id", "metric_value", "time").orderBy("request_id", "place")


@register("resolution_pick", with_views("telemetry", extra=_REQUESTS_SQL + """,
req2 AS (SELECT request_id, start, "end" FROM requests
         UNION ALL SELECT request_id || '-reversed', "end", start FROM requests)""") + f"""SELECT request_id, start, "end",
       (epoch_us("end") - epoch_us(start)) / 86400000000.0 AS range_days,
       {_VIEW_SQL} AS view_used
FROM req2""")
def resolution_pick(spark, sf_dir):
    """P3 per request; reversed requests (start after end) get NULL."""
    req = _requests(tables.telemetry(spark, sf_dir)).select("request_id", "start", "end")
    rev = req.select(F.concat("request_id", F.lit("-reversed")).alias("request_id"),
                     F.col("end").alias("start"), F.col("start").alias("end"))
    both = req.unionByName(rev)
    return both.select("request_id", "start", "end",
                       analytics.range_days(F.col("start"), F.col("end")).alias("range_days"),
                       analytics.resolution_expr(F.col("start"), F.col("end")).alias("view_used"))


@register("analytics_range", with_views("telemetry", extra=_REQUESTS_SQL + f""",
req AS (SELECT *, {_VIEW_SQL} AS view_used FROM requests),
j AS (SELECT r.request_id, r.view_used, r.start, r."end", t.device_id, t.time, t.metric_value,
             CASE r.view_used WHEN '15m' THEN time_bucket(INTERVAL 15 MINUTE, t.time)
                              WHEN '1h' THEN date_trunc('hour', t.time)
                              WHEN '1d' THEN date_trunc('day', t.time)
                              WHEN '1w' THEN date_trunc('week', t.time)
                              WHEN '1mo' THEN date_trunc('month', t.time) END AS bucket
      FROM telemetry t JOIN req r ON t.device_id = r.device_id WHERE r.view_used IS NOT NULL)""") + f"""SELECT request_id, view_used, bucket, device_id, {_ROLLUP_SELECT}
FROM j WHERE bucket >= start AND bucket <= "end"
GROUP BY request_id, view_used, bucket, device_id""", bench=True)
def analytics_range_q(spark, sf_dir):
    """P2+P3: one multi-resolution read per device from the stored rollup views and the tail of readings above them.

    The views are stored once per application and input, and brought up to date when there are newer readings.
    """
    tel = tables.telemetry(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/views-{spark.sparkContext.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    now = tel.agg(F.max("time")).first()[0]
    if now is not None and stored_views.refreshed_at(spark, path) != now:
        stored_views.store_views(tel, path, now)
    views = stored_views.live_views(spark, path, tel) if now is not None else {r: rollups.rollup_state(tel, r) for r in stored_views.VIEWS}
    return stored_views.read_range(views, _requests(tel))

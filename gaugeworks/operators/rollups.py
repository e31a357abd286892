"""Device usage rollups (A1-A9) and batch compaction.

A rollup is a hash aggregate keyed by ``(bucket, device_id)``. Every measure
is decomposable (count, exact decimal sum, min, max, max time), so Spark runs
a partial aggregate before the shuffle: a device holding a third of all rows
still sends only one partial row per bucket and map task. Coarser rollups can
be derived from finer ones (A7) without rereading raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timebuckets import RESOLUTIONS, epoch_ms, time_bucket

ROLLUP_COLUMNS = ["bucket", "device_id", "sample_count", "total_value", "avg_value",
                  "min_value", "max_value", "_aggregate_watermark"]

# Refresh policies (start_offset, end_offset, schedule, compress_after) per view.
# Fixed values.
POLICIES = {
    "15m": ("6 hours", "15 minutes", "15 minutes", "12 hours"),
    "1h": ("3 days", "1 hour", "1 hour", "5 days"),
    "1d": ("14 days", "1 day", "1 day", "21 days"),
    "1w": ("60 days", "7 days", "7 days", "90 days"),
    "1mo": ("180 days", "1 month", "1 month", "270 days"),
    "billing_1d": ("7 days", "1 day", "1 day", "14 days"),
}


def _state_aggs(value: str = "metric_value", time: str = "time") -> list[Column]:
    """Partial rollup state: mergeable across buckets and partitions."""
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.max(time).alias("_aggregate_watermark"),
    ]


def _finalize(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        F.col("sample_count"),
        F.col("sum_value").cast("double").alias("total_value"),
        (F.col("sum_value").cast("double") / F.col("sample_count")).alias("avg_value"),
        F.col("min_value").cast("double").alias("min_value"),
        F.col("max_value").cast("double").alias("max_value"),
        F.col("_aggregate_watermark"),
    )


def rollup_state(telemetry: DataFrame, resolution: str, by_metric: bool = False) -> DataFrame:
    """Unfinalized rollup ``(bucket, device_id[, metric_id], count, sum, min, max, watermark)``."""
    keys = [time_bucket(resolution, "time").alias("bucket"), F.col("device_id")]
    if by_metric:
        keys.append(F.col("metric_id"))
    return telemetry.groupBy(*keys).agg(*_state_aggs())


def device_rollup(telemetry: DataFrame, resolution: str, by_metric: bool = False) -> DataFrame:
    """A1-A5: one row per (bucket, device) at ``resolution`` (15m, 1h, 1d, 1w, 1mo).

    Different metric ids are summed together, as the source views do;
    ``by_metric=True`` keeps them apart.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}")
    keys = ["bucket", "device_id"] + (["metric_id"] if by_metric else [])
    return _finalize(rollup_state(telemetry, resolution, by_metric), keys)


def rollup_from_state(state: DataFrame, resolution: str) -> DataFrame:
    """Re-aggregate a finer rollup state to a coarser resolution (state -> state)."""
    return (state.groupBy(time_bucket(resolution, "bucket").alias("bucket"), "device_id")
                 .agg(F.sum("sample_count").alias("sample_count"),
                      F.sum("sum_value").alias("sum_value"),
                      F.min("min_value").alias("min_value"),
                      F.max("max_value").alias("max_value"),
                      F.max("_aggregate_watermark").alias("_aggregate_watermark")))


def rollup_chain(telemetry: DataFrame) -> dict[str, DataFrame]:
    """15m from raw rows, 1h from 15m, 1d from 1h, 1w and 1mo from 1d.

    Returns finalized DataFrames. Callers that materialize all five should
    persist or write ``15m`` state first so the raw scan happens once.
    """
    s15 = rollup_state(telemetry, "15m")
    s1h = rollup_from_state(s15, "1h")
    s1d = rollup_from_state(s1h, "1d")
    states = {"15m": s15, "1h": s1h, "1d": s1d,
              "1w": rollup_from_state(s1d, "1w"), "1mo": rollup_from_state(s1d, "1mo")}
    return {k: _finalize(v, ["bucket", "device_id"]) for k, v in states.items()}


def billing_aggs() -> list[Column]:
    """Measures of the billing view."""
    return [F.sum("usage_amount").cast("bigint").alias("total_usage"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.count_if(F.col("status") == "settled").alias("settled_count"),
            F.count_if(F.col("status") == "failed").alias("failed_count"),
            F.max("time").alias("_aggregate_watermark")]


def billing_daily(records: DataFrame) -> DataFrame:
    """Daily billing summary per (bucket, account, device)."""
    return records.groupBy(time_bucket("1 day", "time").alias("bucket"), "account_id", "device_id").agg(*billing_aggs())


def batch_compact(telemetry: DataFrame, window_ms: int = 300_000) -> DataFrame:
    """Per device, 5-minute epoch batch and metric -> min/max/avg/sum/count.

    ``batch_id = device_id:batchStartEpochMs``; an empty batch yields no row
    because only observed (batch, device, metric) keys are grouped.
    """
    ms = epoch_ms("time")
    start_ms = ms - F.pmod(ms, F.lit(window_ms))
    g = (telemetry.groupBy("device_id", start_ms.alias("batch_start_ms"), "metric_id")
                  .agg(F.min("metric_value").alias("mn"), F.max("metric_value").alias("mx"),
                       F.sum("metric_value").alias("sm"), F.count(F.lit(1)).alias("n")))
    start = F.timestamp_millis("batch_start_ms").cast("timestamp_ntz")
    return g.select(
        F.concat_ws(":", "device_id", F.col("batch_start_ms").cast("string")).alias("batch_id"),
        "device_id",
        "metric_id",
        start.alias("batch_start"),
        (start + F.expr(f"INTERVAL {window_ms // 1000} SECONDS")).alias("batch_end"),
        F.col("mn").cast("double").alias("min_value"),
        F.col("mx").cast("double").alias("max_value"),
        (F.col("sm").cast("double") / F.col("n")).alias("avg_value"),
        F.col("sm").cast("double").alias("sum_value"),
        F.col("n").alias("event_count"),
    )


def refresh_bounds(telemetry: DataFrame, since: str | Column) -> DataFrame:
    """Aligned refresh range per resolution over rows ingested after ``since``.

    One global partial/final aggregate (min, max of ``time``), then bucket
    alignment: ``[bucket(min), bucket(max) + one bucket)``. Empty input gives
    NULL bounds.
    """
    since_col = F.lit(since).cast("timestamp_ntz") if isinstance(since, str) else since
    mm = (telemetry.where(F.col("ingested_at") >= since_col)
                   .agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"),
                        F.count(F.lit(1)).alias("rows_since")))
    per_view = F.array(*[
        F.struct(F.lit(res).alias("resolution"),
                 time_bucket(res, "min_time").alias("range_start"),
                 (time_bucket(res, "max_time") + F.expr(f"INTERVAL '{width}'"))
                 .cast("timestamp_ntz").alias("range_end"))
        for res, width in RESOLUTIONS.items()])
    return (mm.select("rows_since", F.inline(per_view))
              .select("resolution", "rows_since", "range_start", "range_end"))


def materialize(telemetry: DataFrame, base_path: str, resolutions=("15m", "1h", "1d", "1w", "1mo")) -> dict:
    """Write the rollup views as day-partitioned Parquet tables.

    The 15-minute state is built once from raw rows and checkpointed (to the
    shared ``spark.checkpoint.dir``), so the raw scan runs once and the
    coarser views are re-aggregations of a much smaller table. Returns
    ``{resolution: path}``.
    """
    s15 = rollup_state(telemetry, "15m").checkpoint(eager=True)
    s1h = rollup_from_state(s15, "1h")
    s1d = rollup_from_state(s1h, "1d").checkpoint(eager=True)
    states = {"15m": s15, "1h": s1h, "1d": s1d, "1w": rollup_from_state(s1d, "1w"),
              "1mo": rollup_from_state(s1d, "1mo")}
    paths = {}
    for res in resolutions:
        path = f"{base_path.rstrip('/')}/{res}"
        (_finalize(states[res], ["bucket", "device_id"]).withColumn("day", F.to_date("bucket"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
        paths[res] = path
    return paths

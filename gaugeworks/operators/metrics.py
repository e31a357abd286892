"""Load-test and service metrics (A11-A21, J6) as aggregations.

Everything here is a hash aggregate over a long "event" table, so Spark
combines partial results before the shuffle. Exact percentiles use counts per
distinct value and a running count over the distinct values of a group,
chunked by value range so one large group is still ranked in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Percentiles, histogram bounds, limits.
PERCENTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}
HTTP_BUCKETS_MS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]
GC_PAUSE_BUCKETS_MS = [1, 5, 10, 25, 50, 100, 250, 500]
POOL_WAIT_BUCKETS_MS = [1, 5, 10, 25, 50, 100, 250, 500]
MAX_SERIES = 100_000
P99_TARGET_MS = 500
COMPLIANCE_WINDOW = 1000
COMPLIANCE_EMPTY_SCORE = 0.5
ENTRY_SIZE = 512
# Baseline (CI floor) and the allowed regression; direction of "worse".
BASELINE = {"throughputPerSec": 20.0, "p95LatencyMs": 250.0, "p99LatencyMs": 400.0, "errorRate": 0.05,
            "accepted": 100.0}
BASELINE_DIRECTIONS = {"throughputPerSec": "lower-worse", "accepted": "lower-worse",
                       "p95LatencyMs": "higher-worse", "p99LatencyMs": "higher-worse",
                       "errorRate": "higher-worse"}
MAX_REGRESSION = 0.2


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def exact_percentiles(df: DataFrame, keys, value: str, chunk_width: float | None = None) -> DataFrame:
    """``sorted[min(n-1, floor(q*n))]`` per group for each q in PERCENTILES.

    Not ``percentile_disc`` (that picks ``ceil(q*n)-1``). Steps: counts per
    (group, value) (partial agg), running count over a group's distinct
    values, then the first value whose running count exceeds the index.
    ``chunk_width`` splits a group's value range into chunks ranked in
    parallel (a large group is not sorted in one task).
    """
    keys = _cols(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    chunk = F.floor(F.col(value) / chunk_width) if chunk_width else F.lit(0)
    counts = counts.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_in_cum", F.sum("_c").over(inner))
    per_chunk = counts.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_chunk_n"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_chunk.select(*keys, "_chunk", F.coalesce(F.sum("_chunk_n").over(across), F.lit(0)).alias("_off"))
    cum = (counts.join(offs, [*keys, "_chunk"])
                 .select(*keys, value, (F.col("_off") + F.col("_in_cum")).alias("_cum"), F.col("_c")))
    # Group sizes from the per-chunk summary (a small table), not another pass over the rows.
    n = per_chunk.groupBy(*keys).agg(F.sum("_chunk_n").alias("_n"))
    targets = n.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("_q"),
                 F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n"))).cast("bigint").alias("_idx"))
        for name, q in PERCENTILES.items()])))
    hit = (cum.join(targets, keys)
              .where((F.col("_cum") - F.col("_c") <= F.col("_idx")) & (F.col("_idx") < F.col("_cum"))))
    return (hit.groupBy(*keys).pivot("_q", list(PERCENTILES)).agg(F.first(value)))


def latency_summary(samples: DataFrame, keys, value: str = "latency_ms", exact_sum_scale: int = 6,
                    chunk_width: float = 1.0) -> DataFrame:
    """p50/p90/p95/p99, min, max, avg, count per group (zeros for no samples
    are produced by the caller's left join to the group list)."""
    keys = _cols(keys)
    pct = exact_percentiles(samples, keys, value, chunk_width=chunk_width)
    basic = samples.groupBy(*keys).agg(
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        (F.sum(F.col(value).cast(f"decimal(38,{exact_sum_scale})")).cast("double") / F.count(F.lit(1))).alias("avg_ms"),
        F.count(F.lit(1)).alias("sample_count"))
    return basic.join(pct, keys)


def run_metrics(outcomes: DataFrame, keys, p99_target_ms: float = P99_TARGET_MS, chunk_width: float = 1.0) -> DataFrame:
    """Counts, error rate, throughput per run; latency over samples > 0."""
    keys = _cols(keys)
    o = F.col("outcome")
    g = outcomes.groupBy(*keys).agg(
        F.count_if(o == "accepted").alias("accepted"),
        F.count_if(o == "rejected").alias("rejected"),
        F.count_if((o != "accepted") & (o != "rejected")).alias("errors"),
        ((F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / 1e6)
        .alias("duration_sec"))
    lat = exact_percentiles(outcomes.where(F.col("latency_ms") > 0), keys, "latency_ms", chunk_width).select(
        *keys, F.col("p95_ms"), F.col("p99_ms"))
    total = F.col("accepted") + F.col("rejected") + F.col("errors")
    return (g.join(lat, keys, "left")
             .select(*keys, "accepted", "rejected", "errors", total.alias("total_payloads"),
                     F.when(total == 0, F.lit(0.0)).otherwise((F.col("rejected") + F.col("errors")) / total).alias("error_rate"),
                     "duration_sec",
                     F.when(F.col("duration_sec") > 0, F.col("accepted") / F.col("duration_sec")).otherwise(F.lit(0.0))
                     .alias("throughput_per_sec"),
                     F.when(F.col("duration_sec") > 0, (F.col("accepted") + F.col("rejected")) / F.col("duration_sec"))
                     .otherwise(F.lit(0.0)).alias("completed_per_sec"),
                     F.coalesce("p95_ms", F.lit(0.0)).alias("p95_ms"), F.coalesce("p99_ms", F.lit(0.0)).alias("p99_ms"),
                     (F.coalesce("p99_ms", F.lit(0.0)) <= p99_target_ms).alias("p99_met")))


def rejection_reasons(outcomes: DataFrame, keys=()) -> DataFrame:
    """Rejected and errored samples by reason (``unspecified`` / ``transport`` when missing)."""
    keys = _cols(keys) if keys else []
    o = F.col("outcome")
    reason = F.when(o == "rejected", F.coalesce("reason", F.lit("unspecified"))).otherwise(
        F.coalesce("reason", F.lit("transport")))
    return (outcomes.where(o != "accepted")
                    .groupBy(*keys, reason.alias("reason")).agg(F.count(F.lit(1)).alias("count")))


def cumulative_histogram(df: DataFrame, keys, value: str, bounds) -> DataFrame:
    """Prometheus-style cumulative buckets ``le`` (plus ``+Inf``), sum and count.

    One aggregate computes every bucket count (``count_if(v <= b)``), then the
    array is exploded to one row per bucket.
    """
    keys = _cols(keys)
    agg = df.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(F.lit(1))).alias("_counts"),
        F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("sum"),
        F.count(F.lit(1)).alias("count"))
    les = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    return agg.select(*keys, F.inline(F.arrays_zip(les.alias("le"), F.col("_counts").alias("bucket_count"))), "sum", "count")


def labels_key(labels: Column) -> Column:
    """A canonical string for a label map (sorted by key), usable as a group key."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def series_cardinality(samples: DataFrame, approx: bool = False, limit: int = MAX_SERIES) -> DataFrame:
    """Distinct label sets per metric; flagged above the series limit."""
    key = labels_key(F.col("labels"))
    cnt = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return (samples.groupBy("metric").agg(cnt.alias("series"))
                   .withColumn("over_limit", F.col("series") > limit))


def compliance_scores(subs: DataFrame, device: str = "device_id", order=("time", "event_id"),
                      window: int = COMPLIANCE_WINDOW, chunk: Column | None = None) -> DataFrame:
    """A19 (no expiry): counters clear when the total reaches ``window``; the
    score is successes/total of the open window, 0.5 when it is empty."""
    from ..functions import scan
    numbered = scan.row_number_in_order(subs, device, list(order), chunk=chunk, out="_rn")
    n = numbered.groupBy(device).agg(F.count(F.lit(1)).alias("submissions"))
    open_start = F.floor(F.col("submissions") / window) * window  # rows after this position are in the open window
    j = numbered.join(n, device).where(F.col("_rn") > open_start)
    s = j.groupBy(device).agg(F.count(F.lit(1)).alias("open_total"), F.count_if("success").alias("open_success"))
    out = n.join(s, device, "left").select(
        device, "submissions",
        F.coalesce("open_total", F.lit(0)).alias("open_total"),
        F.coalesce("open_success", F.lit(0)).alias("open_success"))
    return out.withColumn("score", F.when(F.col("open_total") == 0, F.lit(COMPLIANCE_EMPTY_SCORE))
                          .otherwise(F.col("open_success") / F.col("open_total")))


def storage_usage(allocs: DataFrame, device: str = "device_id", bytes_col: str = "bytes") -> DataFrame:
    """Bytes and metered entries per device; each allocation adds ``bytes div 512``."""
    return allocs.groupBy(device).agg(F.sum(bytes_col).alias("usage_bytes"),
                                      F.sum(F.floor(F.col(bytes_col) / ENTRY_SIZE)).cast("bigint").alias("metered_entries"))


def peak_per_second(times: DataFrame, t: str = "t", keys=()) -> DataFrame:
    """Count per whole second, then the maximum."""
    keys = _cols(keys) if keys else []
    per = times.groupBy(*keys, F.floor(F.col(t)).alias("_sec")).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.max("_n").alias("peak_per_second"), F.count(F.lit(1)).alias("active_seconds"),
                                  F.sum("_n").alias("events"))


def compare_to_baseline(current: DataFrame, keys, baseline: dict = BASELINE, max_regression: float = MAX_REGRESSION) -> DataFrame:
    """Unpivot current metrics, join the baseline, direction-aware regression.

    Fraction = delta in the worse direction / |baseline|; a zero baseline
    gives 1 if worse else 0; regressed iff fraction > max (strict).
    """
    keys = _cols(keys)
    names = list(BASELINE_DIRECTIONS)
    cur = current.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("current")) for m in names])))
    base = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(float(baseline[m])))])
    direction = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(BASELINE_DIRECTIONS[m]))])
    b = F.element_at(base, F.col("metric"))
    d = F.element_at(direction, F.col("metric"))
    delta = F.when(d == "higher-worse", F.col("current") - b).otherwise(b - F.col("current"))
    frac = F.when(b == 0, F.when(delta > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(delta / F.abs(b))
    return cur.select(*keys, "metric", b.alias("baseline"), "current", frac.alias("regression_pct"),
                      (frac > max_regression).alias("regressed"))


def approx_percentiles(df: DataFrame, keys, value: str, accuracy: int = 10_000) -> DataFrame:
    """A11 fast path: ``percentile_approx`` per group (one partial aggregate,
    fixed-size sketches), for dashboards where the exact index rule is not
    required."""
    keys = _cols(keys)
    qs = list(PERCENTILES.values())
    return (df.groupBy(*keys).agg(F.percentile_approx(value, qs, accuracy).alias("_p"))
              .select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(PERCENTILES)]))

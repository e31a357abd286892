"""Queries: latency summaries, run metrics, labelled metrics and advisors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebuckets import time_bucket
from ..operators import metrics as M
from ..operators import validation as V
from ..sources import tables
from .oracle_views import with_views
from .registry import register

_PCT_SQL = """list_sort(list({v}))[CAST(LEAST(COUNT(*) - 1, floor({q} * COUNT(*))) AS BIGINT) + 1]"""


def _pcts(v: str) -> str:
    return ",\n       ".join(f"{_PCT_SQL.format(v=v, q=q)} AS {name}" for name, q in M.PERCENTILES.items())


@register("latency_summary", with_views("outcomes") + f"""SELECT profile, MIN(latency_ms) AS min_ms, MAX(latency_ms) AS max_ms,
       CAST(SUM(CAST(latency_ms AS DECIMAL(38,6))) AS DOUBLE) / COUNT(*) AS avg_ms, COUNT(*) AS sample_count,
       {_pcts('latency_ms')}
FROM outcomes GROUP BY profile""", bench=True)
def latency_summary(spark, sf_dir):
    """Exact index percentiles (``sorted[min(n-1, floor(q n))]``) per profile."""
    return M.latency_summary(tables.outcomes(spark, sf_dir), "profile")


def _runs(spark, sf_dir) -> DataFrame:
    o = tables.outcomes(spark, sf_dir)
    return o.withColumn("run_day", F.to_date("time"))


_RUN_SQL = f"""runs AS (
  SELECT CAST(time AS DATE) AS run_day,
         COUNT(*) FILTER (WHERE outcome = 'accepted') AS accepted,
         COUNT(*) FILTER (WHERE outcome = 'rejected') AS rejected,
         COUNT(*) FILTER (WHERE outcome <> 'accepted' AND outcome <> 'rejected') AS errors,
         (epoch_us(MAX(time)) - epoch_us(MIN(time))) / 1e6 AS duration_sec
  FROM outcomes GROUP BY 1),
lat AS (SELECT CAST(time AS DATE) AS run_day, {_PCT_SQL.format(v='latency_ms', q=0.95)} AS p95_ms,
               {_PCT_SQL.format(v='latency_ms', q=0.99)} AS p99_ms
        FROM outcomes WHERE latency_ms > 0 GROUP BY 1),
rm AS (SELECT r.run_day, accepted, rejected, errors, accepted + rejected + errors AS total_payloads,
              CASE WHEN accepted + rejected + errors = 0 THEN 0.0
                   ELSE (rejected + errors) / (accepted + rejected + errors) END AS error_rate,
              duration_sec,
              CASE WHEN duration_sec > 0 THEN accepted / duration_sec ELSE 0.0 END AS throughput_per_sec,
              CASE WHEN duration_sec > 0 THEN (accepted + rejected) / duration_sec ELSE 0.0 END AS completed_per_sec,
              COALESCE(p95_ms, 0.0) AS p95_ms, COALESCE(p99_ms, 0.0) AS p99_ms,
              COALESCE(p99_ms, 0.0) <= 500 AS p99_met
       FROM runs r LEFT JOIN lat l ON r.run_day = l.run_day)"""


@register("run_metrics", with_views("outcomes", extra=_RUN_SQL) + "SELECT * FROM rm")
def run_metrics(spark, sf_dir):
    """Per-day run metrics over the outcome log."""
    return M.run_metrics(_runs(spark, sf_dir), "run_day")


@register("baseline_compare", with_views("outcomes", extra=_RUN_SQL + """,
cur AS (SELECT run_day, m.metric, m.current FROM rm,
        (VALUES ('throughputPerSec'), ('accepted'), ('p95LatencyMs'), ('p99LatencyMs'), ('errorRate')) v(metric_name),
        LATERAL (SELECT v.metric_name AS metric,
                        CAST(CASE v.metric_name WHEN 'throughputPerSec' THEN throughput_per_sec WHEN 'accepted' THEN accepted
                                                WHEN 'p95LatencyMs' THEN p95_ms WHEN 'p99LatencyMs' THEN p99_ms
                                                ELSE error_rate END AS DOUBLE) AS current) m),
b AS (SELECT * FROM (VALUES ('throughputPerSec', 20.0, 'lower-worse'), ('accepted', 100.0, 'lower-worse'),
                            ('p95LatencyMs', 250.0, 'higher-worse'), ('p99LatencyMs', 400.0, 'higher-worse'),
                            ('errorRate', 0.05, 'higher-worse')) t(metric, baseline, direction)),
j AS (SELECT cur.run_day, cur.metric, CAST(b.baseline AS DOUBLE) AS baseline, cur.current,
             CASE WHEN b.direction = 'higher-worse' THEN cur.current - b.baseline ELSE b.baseline - cur.current END AS delta
      FROM cur JOIN b ON cur.metric = b.metric)""") + """SELECT run_day, metric, baseline, current,
       CASE WHEN baseline = 0 THEN CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END ELSE delta / abs(baseline) END AS regression_pct,
       CASE WHEN baseline = 0 THEN CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END ELSE delta / abs(baseline) END > 0.2 AS regressed
FROM j""")
def baseline_compare(spark, sf_dir):
    """Each day's run metrics against the CI baseline (20 % allowed regression)."""
    rm = M.run_metrics(_runs(spark, sf_dir), "run_day")
    cur = rm.select("run_day", F.col("throughput_per_sec").alias("throughputPerSec"), "accepted",
                    F.col("p95_ms").alias("p95LatencyMs"), F.col("p99_ms").alias("p99LatencyMs"),
                    F.col("error_rate").alias("errorRate"))
    return M.compare_to_baseline(cur, "run_day")


def _reasons(spark, sf_dir) -> DataFrame:
    o = tables.outcomes(spark, sf_dir)
    reason = (F.when((F.col("outcome") == "rejected") & (F.col("k") % 3 != 0),
                     F.concat(F.lit("reason-"), (F.col("k") % 4).cast("string")))
               .when((F.col("outcome") == "error") & (F.col("k") % 2 == 1), F.lit("http_500")))
    return o.withColumn("reason", reason)


@register("reject_reasons", with_views("outcomes") + """SELECT CASE WHEN outcome = 'rejected' THEN COALESCE(reason, 'unspecified') ELSE COALESCE(reason, 'transport') END AS reason,
       COUNT(*) AS count
FROM (SELECT *, CASE WHEN outcome = 'rejected' AND k % 3 <> 0 THEN 'reason-' || CAST(k % 4 AS VARCHAR)
                     WHEN outcome = 'error' AND k % 2 = 1 THEN 'http_500' END AS reason FROM outcomes)
WHERE outcome <> 'accepted' GROUP BY 1""")
def reject_reasons(spark, sf_dir):
    """Rejections and errors by reason."""
    return M.rejection_reasons(_reasons(spark, sf_dir))


_LABELS_SQL = """lab AS (SELECT *, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant,
                         ['standard', 'premium', 'enterprise'][user_id % 3 + 1] AS device_tier,
                         CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'rejected'
                              ELSE 'accepted' END AS status
             FROM telemetry)"""


def _labelled(spark, sf_dir) -> DataFrame:
    t = tables.telemetry(spark, sf_dir)
    tiers = F.array(F.lit("standard"), F.lit("premium"), F.lit("enterprise"))
    et = F.col("event_type")
    return t.select("*", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant"),
                    F.element_at(tiers, (F.col("user_id") % 3 + 1).cast("int")).alias("device_tier"),
                    F.when(et == "error", "error").when(et == "signup", "rejected").otherwise("accepted").alias("status"))


@register("ingest_counter", with_views("telemetry", extra=_LABELS_SQL) + """SELECT date_trunc('minute', time) AS flush_minute, tenant, device_tier, region, status, COUNT(*) AS increments
FROM lab GROUP BY 1, 2, 3, 4, 5""")
def ingest_counter(spark, sf_dir):
    """Ingestion counter pre-aggregated per 60 s flush (device id dropped)."""
    d = _labelled(spark, sf_dir)
    return (d.groupBy(time_bucket("1 minute", "time").alias("flush_minute"), "tenant", "device_tier", "region", "status")
             .agg(F.count(F.lit(1)).alias("increments")))


@register("gauge_last", with_views("telemetry", extra=_LABELS_SQL) + """SELECT date_trunc('minute', time) AS flush_window, tenant, device_tier, region,
       arg_max(k * 1024, (time, event_id)) AS buffer_bytes
FROM lab GROUP BY 1, 2, 3, 4""")
def gauge_last(spark, sf_dir):
    """Last connection-buffer gauge value per label set and 60 s flush."""
    d = _labelled(spark, sf_dir).withColumn("buffer_bytes", F.col("k") * 1024)
    return (d.groupBy(time_bucket("1 minute", "time").alias("flush_window"), "tenant", "device_tier", "region")
             .agg(F.max_by("buffer_bytes", F.struct("time", "event_id")).alias("buffer_bytes")))


_BOUNDS = M.HTTP_BUCKETS_MS


@register("histogram_le", with_views("outcomes", extra="""
req AS (SELECT CASE profile WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' ELSE 'POST' END AS method,
               '/api/' || profile AS route,
               CASE outcome WHEN 'accepted' THEN '200' WHEN 'rejected' THEN '422' ELSE '500' END AS status_code,
               latency_ms FROM outcomes),
bounds AS (SELECT * FROM (VALUES """ + ", ".join(f"('{b}', {i}, CAST({b} AS DOUBLE))" for i, b in enumerate(_BOUNDS))
          + f""", ('+Inf', {len(_BOUNDS)}, CAST('inf' AS DOUBLE))) t(le, pos, bound))""") + """SELECT r.method, r.route, r.status_code, b.le,
       COUNT(*) FILTER (WHERE r.latency_ms <= b.bound) AS bucket_count,
       CAST(SUM(CAST(r.latency_ms AS DECIMAL(38,6))) AS DOUBLE) AS sum, COUNT(*) AS count
FROM req r, bounds b GROUP BY r.method, r.route, r.status_code, b.le""")
def histogram_le(spark, sf_dir):
    """HTTP duration histogram with cumulative ``le`` buckets per label set."""
    o = tables.outcomes(spark, sf_dir)
    p = F.col("profile")
    req = o.select(F.when(p.isin("view", "click"), "GET").otherwise("POST").alias("method"),
                   F.concat(F.lit("/api/"), p).alias("route"),
                   F.when(F.col("outcome") == "accepted", "200").when(F.col("outcome") == "rejected", "422")
                    .otherwise("500").alias("status_code"), "latency_ms")
    return M.cumulative_histogram(req, ["method", "route", "status_code"], "latency_ms", _BOUNDS)


def _metric_events(spark, sf_dir) -> DataFrame:
    """A long metric-event table: tx status, rate-limit decisions, gap losses, config transitions, pool rejections, poll errors."""
    from ..operators import sequence
    r = tables.billing_records(spark, sf_dir)
    tx = r.select(F.lit("blockchain_transactions_total").alias("metric"),
                  F.create_map(F.lit("status"), F.col("status")).alias("labels"), F.lit(1).cast("bigint").alias("value"))
    o = tables.outcomes(spark, sf_dir)
    rl = o.select(F.lit("rate_limiter_redis_hits_total").alias("metric"),
                  F.create_map(F.lit("decision"), F.when(F.col("outcome") == "accepted", "allowed").otherwise("denied"))
                  .alias("labels"), F.lit(1).cast("bigint").alias("value"))
    gaps = sequence.sequence_gaps(tables.ledger(spark, sf_dir), chunk=time_bucket("1 hour", "arrival_ts"))
    gl = gaps.where(F.col("missing_count") > 0).select(
        F.lit("ledger_gap_events_lost_total").alias("metric"),
        F.create_map(F.lit("stream"), F.col("stream_id")).alias("labels"), F.col("missing_count").cast("bigint").alias("value"))
    t, k, one = tables.telemetry(spark, sf_dir), F.col("k"), F.lit(1).cast("bigint").alias("value")
    version = [F.concat(F.lit("v"), F.pmod(k + i, F.lit(3)).cast("string")) for i in (0, 1)]
    moved = t.where("event_type = 'signup'").select(F.lit("config_transition_events").alias("metric"), F.create_map(
        F.lit("start_version"), version[0], F.lit("end_version"), version[1]).alias("labels"), one)
    refused = t.where("event_type = 'error'").select(F.lit("tenant_pool_rejections_total").alias("metric"),
                                                     F.create_map(F.lit("tenant_id"), "tenant_id").alias("labels"), one)
    polls = t.where(k % 10 == 0).select(F.lit("ledger_sync_poll_errors_total").alias("metric"), F.create_map(
        F.lit("sync_id"), F.lit("ledger"), F.lit("phase"), F.when(k % 20 == 0, "poll").otherwise("fetch")).alias("labels"), one)
    return tx.unionByName(rl).unionByName(gl).unionByName(moved).unionByName(refused).unionByName(polls)


@register("labelled_counts", with_views("billing_records", "outcomes", "ledger", "telemetry", extra="""
gaps AS (SELECT stream_id, sequence - prev - 1 AS missing FROM (
           SELECT *, MAX(sequence) OVER (PARTITION BY stream_id ORDER BY arrival_ts, arrival_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ledger)
         WHERE prev IS NOT NULL AND sequence > prev + 1),
ev AS (SELECT 'blockchain_transactions_total' AS metric, 'status=' || status AS labels, CAST(1 AS BIGINT) AS value FROM billing_records
       UNION ALL SELECT 'rate_limiter_redis_hits_total', 'decision=' || CASE WHEN outcome = 'accepted' THEN 'allowed' ELSE 'denied' END, 1 FROM outcomes
       UNION ALL SELECT 'ledger_gap_events_lost_total', 'stream=' || stream_id, missing FROM gaps WHERE missing > 0
       UNION ALL SELECT 'config_transition_events', 'end_version=v' || CAST((k + 1) % 3 AS VARCHAR) || ',start_version=v' || CAST(k % 3 AS VARCHAR), 1
       FROM telemetry WHERE event_type = 'signup'
       UNION ALL SELECT 'tenant_pool_rejections_total', 'tenant_id=' || tenant_id, 1 FROM telemetry WHERE event_type = 'error'
       UNION ALL SELECT 'ledger_sync_poll_errors_total', 'phase=' || CASE WHEN k % 20 = 0 THEN 'poll' ELSE 'fetch' END || ',sync_id=ledger', 1
       FROM telemetry WHERE k % 10 = 0)""") + """SELECT metric, labels, CAST(SUM(value) AS BIGINT) AS value FROM ev GROUP BY metric, labels""")
def labelled_counts(spark, sf_dir):
    """Labelled event counts summed per (metric, label set)."""
    ev = _metric_events(spark, sf_dir)
    return (ev.groupBy("metric", M.labels_key(F.col("labels")).alias("labels"))
              .agg(F.sum("value").cast("bigint").alias("value")))


@register("series_cardinality", with_views("telemetry", extra=_LABELS_SQL) + """SELECT 'ingestion_packets_total' AS metric,
       COUNT(DISTINCT 'device_tier=' || device_tier || ',region=' || region || ',status=' || status || ',tenant_id=' || tenant) AS series,
       false AS over_limit FROM lab
UNION ALL
SELECT 'device_last_seen', COUNT(DISTINCT 'device_id=' || device_id), COUNT(DISTINCT device_id) > 100000 FROM lab
UNION ALL
SELECT 'request_trace', COUNT(*) * 12, COUNT(*) * 12 > 100000 FROM lab""")
def series_cardinality(spark, sf_dir):
    """Series per metric (distinct label sets), flagged above 100 000."""
    d = _labelled(spark, sf_dir)
    ing = d.select(F.lit("ingestion_packets_total").alias("metric"),
                   F.create_map(F.lit("tenant_id"), "tenant", F.lit("device_tier"), "device_tier",
                                F.lit("region"), "region", F.lit("status"), "status").alias("labels"))
    dev = d.select(F.lit("device_last_seen").alias("metric"), F.create_map(F.lit("device_id"), "device_id").alias("labels"))
    # a label set per request and retry: the kind of metric the guard is there for
    retry = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("retry")
    trace = d.select("event_id", retry).select(F.lit("request_trace").alias("metric"), F.create_map(
        F.lit("request_id"), F.col("event_id").cast("string"), F.lit("retry"), F.col("retry").cast("string")).alias("labels"))
    return M.series_cardinality(ing.unionByName(dev).unionByName(trace))


@register("compliance_score", with_views("outcomes", extra="""
s AS (SELECT 'dev-' || CAST(e.user_id AS VARCHAR) AS device_id, o.outcome = 'accepted' AS success,
             row_number() OVER (PARTITION BY e.user_id ORDER BY o.time, o.event_id) AS rn,
             COUNT(*) OVER (PARTITION BY e.user_id) AS n
      FROM outcomes o JOIN events e ON o.event_id = e.event_id)""") + """SELECT device_id, MAX(n) AS submissions,
       COUNT(*) FILTER (WHERE rn > floor(n / 50) * 50) AS open_total,
       COUNT(*) FILTER (WHERE rn > floor(n / 50) * 50 AND success) AS open_success,
       CASE WHEN COUNT(*) FILTER (WHERE rn > floor(n / 50) * 50) = 0 THEN 0.5
            ELSE COUNT(*) FILTER (WHERE rn > floor(n / 50) * 50 AND success)
                 / COUNT(*) FILTER (WHERE rn > floor(n / 50) * 50) END AS score
FROM s GROUP BY device_id""")
def compliance_score(spark, sf_dir):
    """A19 (no expiry): success ratio of the open window; window 50 at driver scale."""
    subs = tables.outcomes(spark, sf_dir).select("device_id", "time", "event_id",
                    (F.col("outcome") == "accepted").alias("success"))
    return M.compliance_scores(subs, window=50, chunk=time_bucket("1 day", "time"))


@register("storage_usage", with_views("telemetry") + """SELECT device_id, CAST(SUM(512 * (k % 8) + (event_id % 3) * 100) AS BIGINT) AS usage_bytes,
       CAST(SUM(floor((512 * (k % 8) + (event_id % 3) * 100) / 512)) AS BIGINT) AS metered_entries
FROM telemetry GROUP BY device_id""")
def storage_usage(spark, sf_dir):
    """Storage bytes and metered entries per device."""
    t = tables.telemetry(spark, sf_dir)
    allocs = t.select("device_id", (512 * (F.col("k") % 8) + (F.col("event_id") % 3) * 100).alias("bytes"))
    return M.storage_usage(allocs)


@register("peak_per_second", with_views("telemetry") + """SELECT MAX(n) AS peak_per_second, COUNT(*) AS active_seconds, CAST(SUM(n) AS BIGINT) AS events FROM (
  SELECT floor(CAST(('0x' || substr(sha256('tok-' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * 121) AS sec,
         COUNT(*) AS n
  FROM telemetry GROUP BY 1)""")
def peak_per_second(spark, sf_dir):
    """Token reconnects spread by a 120 s hash jitter; peak per second."""
    t = tables.telemetry(spark, sf_dir)
    u = V.hash_unit_interval(F.concat(F.lit("tok-"), F.col("event_id").cast("string")))
    return M.peak_per_second(t.select((u * 121).alias("t")))


@register("partition_advice", with_views("telemetry", extra="""
chunks AS (SELECT region, date_trunc('day', time) AS range_start, date_trunc('day', time) + INTERVAL 1 DAY AS range_end,
                  COUNT(*) * 48000 AS total_bytes FROM telemetry GROUP BY 1, 2),
cand AS (SELECT * FROM chunks WHERE range_start >= TIMESTAMP '2024-01-23' AND range_end <= TIMESTAMP '2024-01-30 12:00:00'),
latest AS (SELECT region, arg_max(range_start, range_end) AS chunk_start, arg_max(total_bytes, range_end) AS total_bytes,
                  arg_max(epoch(range_end) - epoch(range_start), range_end) AS span_secs FROM cand GROUP BY region),
regions AS (SELECT DISTINCT region FROM telemetry)""") + """SELECT r.region, l.chunk_start, l.total_bytes,
       CASE WHEN l.total_bytes IS NULL OR l.total_bytes = 0 OR l.span_secs IS NULL OR l.span_secs <= 0 THEN 86400.0
            ELSE LEAST(GREATEST(5.0 * 1024 * 1024 * 1024 / l.total_bytes * l.span_secs, 3600.0), 604800.0) END AS interval_seconds
FROM regions r LEFT JOIN latest l ON r.region = l.region""")
def partition_advice(spark, sf_dir):
    """Next partition span per region from its latest closed, uncompressed day."""
    t = tables.telemetry(spark, sf_dir)
    chunks = (t.groupBy("region", time_bucket("1 day", "time").alias("range_start"))
               .agg((F.count(F.lit(1)) * 48000).alias("total_bytes"))
               .withColumn("range_end", (F.col("range_start") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")))
    cand = chunks.where((F.col("range_start") >= F.lit("2024-01-23").cast("timestamp_ntz"))
                        & (F.col("range_end") <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")))
    latest = (cand.groupBy("region")
                  .agg(F.max_by(F.struct("range_start", "range_end", "total_bytes"), "range_end").alias("c"))
                  .select("region", F.col("c.range_start").alias("chunk_start"), F.col("c.total_bytes").alias("total_bytes"),
                          (F.unix_seconds(F.col("c.range_end").cast("timestamp"))
                           - F.unix_seconds(F.col("c.range_start").cast("timestamp"))).alias("span_secs")))
    regions = t.select("region").distinct()
    j = regions.join(latest, "region", "left")
    secs = F.least(F.greatest(F.lit(5.0 * 1024 ** 3) / F.col("total_bytes") * F.col("span_secs"), F.lit(3600.0)),
                   F.lit(604800.0))
    bad = F.col("total_bytes").isNull() | (F.col("total_bytes") == 0) | F.col("span_secs").isNull() | (F.col("span_secs") <= 0)
    return j.select("region", "chunk_start", "total_bytes",
                    F.when(bad, F.lit(86400.0)).otherwise(secs).alias("interval_seconds"))


@register("compliance_expiry", with_views("outcomes", extra="""
o AS (SELECT 'dev-' || CAST(e.user_id AS VARCHAR) AS device_id, o.event_id, epoch_us(o.time) // 1000 AS time_ms,
             o.outcome = 'accepted' AS success,
             row_number() OVER (PARTITION BY e.user_id ORDER BY epoch_us(o.time) // 1000, o.event_id) AS rn
      FROM outcomes o JOIN events e ON o.event_id = e.event_id),
r AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS succ,
             CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS last_ms
      FROM o
      UNION ALL
      SELECT device_id, rn, event_id,
             CASE WHEN t1 >= 50 THEN 0 ELSE s1 END, CASE WHEN t1 >= 50 THEN 0 ELSE t1 END, time_ms
      FROM (SELECT o.device_id, o.rn, o.event_id, o.time_ms,
                   CASE WHEN r.last_ms IS NOT NULL AND o.time_ms - r.last_ms >= 3600000 THEN 0 ELSE r.succ END
                     + CASE WHEN o.success THEN 1 ELSE 0 END AS s1,
                   CASE WHEN r.last_ms IS NOT NULL AND o.time_ms - r.last_ms >= 3600000 THEN 0 ELSE r.total END + 1 AS t1
            FROM r JOIN o ON o.device_id = r.device_id AND o.rn = r.rn + 1))""", recursive=True) + """SELECT device_id, event_id, CASE WHEN total = 0 THEN 0.5 ELSE succ / total END AS score, total AS window_total
FROM r WHERE rn > 0""")
def compliance_expiry(spark, sf_dir):
    """A19 with expiry: score after each submission; counters clear at 50
    submissions (driver scale) or after one hour without a write."""
    from ..functions.timebuckets import epoch_ms
    from ..operators import folds
    subs = tables.outcomes(spark, sf_dir).select("device_id", "event_id",
                    epoch_ms("time").alias("time_ms"), (F.col("outcome") == "accepted").alias("success"))
    out = folds.compliance_with_expiry(subs, order=["time_ms", "event_id"], window=50, ttl_ms=3_600_000)
    return out.select("device_id", "event_id", "score", "window_total")

"""Queries: stores, logs and stateful streams run over several files and read back.

Each gives what its batch twin gives, so most share that query's SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import billing, folds, stored_views
from ..operators.rollups import POLICIES
from ..sources import tables, telemetry_store
from ..sources.stored import entries
from ..streaming import ledger_bus, resync, sinks, stateful
from ..streaming import rollups as srollups
from . import catalog_folds, catalog_metrics, catalog_sequence  # noqa: F401  (their SQL is shared)
from .catalog_folds import _FRAGMENTS_SQL, _chunks, _frames
from .catalog_rollups import _rollup_sql
from .catalog_streaming import CLOCK_SQL, _clock, _scratch, arriving, arriving_events
from .oracle_views import K, with_views
from .registry import ORACLE, register


def _run(stream, out: str, checkpoint: str):
    """Run an append stream to its end and read its files."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with sinks.batch_partitions(stream.sparkSession):
        q = w.start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _run_batches(stream, sink, checkpoint: str, mode: str = "append") -> None:
    w = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with sinks.batch_partitions(stream.sparkSession):
        q = w.start()
    q.awaitTermination()


# --------------------------------------------------------------------------- stores


_READINGS = with_views("telemetry") + "SELECT time, device_id, metric_id, metric_value, region FROM telemetry"
_READING_COLUMNS = ["time", "device_id", "metric_id", "metric_value", "region"]


@register("raw_append", _READINGS)
def raw_append(spark, sf_dir):
    """Readings appended in two writes and read back."""
    path, _ = _scratch(spark, "raw-append")
    t = tables.telemetry(spark, sf_dir).select(*_READING_COLUMNS, "ingested_at")
    even = F.pmod(F.xxhash64("device_id", "time"), F.lit(2)) == 0
    telemetry_store.write_telemetry(t.where(even), path)
    telemetry_store.write_telemetry(t.where(~even), path)
    return telemetry_store.read_telemetry(spark, path).select(*_READING_COLUMNS)


@register("aged_layout", _READINGS)
def aged_layout(spark, sf_dir):
    """S3: days before the median day rewritten; the whole table read from both layouts."""
    path, _ = _scratch(spark, "aged-layout")
    t = tables.telemetry(spark, sf_dir).select(*_READING_COLUMNS, "ingested_at")
    telemetry_store.write_telemetry(t, path)
    middle = spark.read.parquet(path).select(F.percentile_approx(F.unix_date("day"), 0.5)).first()[0]
    day = str(dt.date(1970, 1, 1) + dt.timedelta(days=int(middle or 0)))
    telemetry_store.compact_layout(spark, path, f"{path}-aged", day).first()
    return telemetry_store.read_layout(spark, path, f"{path}-aged", day).select(*_READING_COLUMNS)


@register("tenant_reads", with_views("telemetry") + """SELECT 'tenant_' || tenant_id AS tenant_schema, device_id, COUNT(*) AS readings, MAX(time) AS last_time
FROM telemetry GROUP BY 1, 2""")
def tenant_reads(spark, sf_dir):
    """Readings in a store partitioned by tenant; every read names one tenant and scans its partition alone."""
    path, _ = _scratch(spark, "tenants")
    telemetry_store.write_tenants(tables.telemetry(spark, sf_dir).select("tenant_id", *_READING_COLUMNS), path)
    out = None
    for n in range(5):
        rows = telemetry_store.tenant_scan(spark, path, F.col("tenant_schema") == telemetry_store.schema_of(f"t{n}"))
        part = rows.groupBy("tenant_schema", "device_id").agg(F.count(F.lit(1)).alias("readings"), F.max("time").alias("last_time"))
        out = part if out is None else out.unionByName(part)
    return out


@register("known_states", with_views("billing_records", extra="""
s AS (SELECT record_id AS id, ['OPEN', 'FINALIZING', 'FINALIZED', 'SETTLED', 'BOGUS', NULL][CAST(record_id % 6 AS INTEGER) + 1] AS state FROM billing_records)""") + """SELECT id, state, state IS NOT NULL AND state <> 'BOGUS' AS known FROM s""")
def known_states(spark, sf_dir):
    """Stored cycle states, the unknown ones quarantined."""
    names = F.array(*[F.lit(x) for x in (*billing.CYCLE_STATES, "BOGUS", None)])
    s = tables.billing_records(spark, sf_dir).select(F.col("record_id").alias("id"), F.get(names, (F.col("record_id") % 6).cast("int")).alias("state"))
    known = billing.guard_known_state(s, mode="quarantine").withColumn("known", F.lit(True))
    return known.unionByName(billing.unknown_states(s).withColumn("known", F.lit(False)))


# --------------------------------------------------------------------------- ledger log and progress


@register("stream_progress", with_views("ledger") + "SELECT 'ledger' AS sync_id, MAX(sequence) AS last_synced FROM ledger")
def stream_progress(spark, sf_dir):
    """The highest processed sequence after several micro-batches."""
    out, ckpt = _scratch(spark, "progress")
    led = tables.ledger_from(arriving_events(spark, sf_dir, ckpt + "-src"))
    _run_batches(led, sinks.sync_state_sink(out), ckpt)
    return sinks.sync_state(spark, out).select("sync_id", "last_synced")


@register("stream_ledger", with_views("ledger") + """SELECT row_number() OVER (ORDER BY sequence) AS seq, CAST(sequence AS VARCHAR) AS ledger FROM ledger""")
def stream_ledger(spark, sf_dir):
    """Ledgers published to the log in two appends, consumed into an exactly-once sink."""
    out, ckpt = _scratch(spark, "ledger-log")
    led = tables.ledger(spark, sf_dir).select(F.col("sequence").alias("order"), F.create_map(F.lit("ledger"), F.col("sequence").cast("string")).alias("payload"))
    half = led.select(F.percentile_approx("order", 0.5)).first()[0] or 0
    segment = max(64, led.count() // 8)
    for part in (led.where(F.col("order") <= half), led.where(F.col("order") > half)):
        ledger_bus.publish(spark, ckpt + "-log", part, segment)
    ledger_bus.consume(spark, ckpt + "-log", ckpt, sinks.insert_ignore_sink(out, ["seq"]), count=2 * segment, segment=segment).awaitTermination()
    return spark.read.parquet(out).select("seq", F.col("payload")["ledger"].alias("ledger"))


@register("ledger_pending", with_views("ledger", extra="""
n AS (SELECT COUNT(*) AS entries FROM ledger), s AS (SELECT entries, greatest(64, entries // 5) AS bound FROM n)""") + """SELECT entries AS published, 2 * bound AS acknowledged_before,
       least(bound, entries - 2 * bound) AS pending_after_stop, CAST(0 AS BIGINT) AS pending_after_resume, entries AS consumed, bound AS largest_read FROM s""")
def ledger_pending(spark, sf_dir):
    """A consumer of bounded reads fails in its third read; that read is pending until the resumed consumer acknowledges it."""
    out, ckpt = _scratch(spark, "ledger-pending")
    led = tables.ledger(spark, sf_dir).select(F.col("sequence").alias("order"), F.create_map(F.lit("ledger"), F.col("sequence").cast("string")).alias("payload"))
    published = led.count()
    bound = max(64, published // 5)
    log = f"{ckpt}-log"
    ledger_bus.publish(spark, log, led.repartition(1), bound)
    store = sinks.insert_ignore_sink(f"{out}/entries", ["seq"])

    def handle(batch, epoch_id):
        store(batch, epoch_id)
        batch.agg(F.count(F.lit(1)).alias("n")).withColumn("epoch", F.lit(epoch_id)).write.mode("append").parquet(f"{out}/reads")

    def fails(batch, epoch_id):
        handle(batch, epoch_id) if epoch_id < 2 else 1 // 0

    stopped = ledger_bus.consume(spark, log, ckpt, fails, count=bound, segment=bound)
    try:
        stopped.awaitTermination()
    except StreamingQueryException:
        pass  # the planned failure
    waiting = ledger_bus.pending_count(spark, ckpt)
    before = spark.read.parquet(f"{out}/entries").count()
    ledger_bus.consume(spark, log, ckpt, handle, count=bound, segment=bound).awaitTermination()
    left = ledger_bus.pending_count(spark, ckpt)
    stored = spark.read.parquet(f"{out}/entries").agg(F.count(F.lit(1)).alias("consumed"))
    reads = spark.read.parquet(f"{out}/reads").agg(F.max("n").alias("largest_read"))
    known = [F.lit(v).cast("bigint").alias(n) for n, v in (("published", published), ("acknowledged_before", before), ("pending_after_stop", waiting), ("pending_after_resume", left))]
    return stored.select(*known, "consumed", F.lit(reads.first()[0]).cast("bigint").alias("largest_read"))


_VIEW_STATS = {"15m": ("time_bucket(INTERVAL 15 MINUTE, time)", "INTERVAL 15 MINUTE + INTERVAL 15 MINUTE", "INTERVAL 12 HOUR", "day"),
               "1h": ("date_trunc('hour', time)", "INTERVAL 1 HOUR + INTERVAL 1 HOUR", "INTERVAL 5 DAY", "day"),
               "1d": ("date_trunc('day', time)", "INTERVAL 1 DAY + INTERVAL 1 DAY", "INTERVAL 21 DAY", "month"),
               "1w": ("date_trunc('week', time)", "INTERVAL 7 DAY + INTERVAL 7 DAY", "INTERVAL 90 DAY", "month"),
               "1mo": ("date_trunc('month', time)", "INTERVAL 1 MONTH + INTERVAL 1 MONTH", "INTERVAL 270 DAY", "month")}


def _aged_sql() -> str:
    views = "".join(f"""
UNION ALL SELECT 'usage_{v}', COUNT(DISTINCT part) FILTER (aged), COUNT(*), COUNT(DISTINCT part) FILTER (aged) > 0 FROM (
  SELECT date_trunc('{part}', bucket) AS part, date_trunc('{part}', bucket) + INTERVAL 1 {part.upper()} <= (SELECT moment FROM now) - {age} AS aged
  FROM (SELECT DISTINCT {bucket} AS bucket, device_id FROM telemetry) WHERE bucket + {closed} <= (SELECT moment FROM now))""" for v, (bucket, closed, age, part) in _VIEW_STATS.items())
    return f"""SELECT 'telemetry' AS table_name, COUNT(DISTINCT day) FILTER (day + INTERVAL 1 DAY <= (SELECT moment FROM now) - INTERVAL 7 DAY) AS partitions, COUNT(*) AS rows_kept,
       COUNT(DISTINCT day) FILTER (day + INTERVAL 1 DAY <= (SELECT moment FROM now) - INTERVAL 7 DAY) > 0 AS ratio_known
FROM (SELECT date_trunc('day', time) AS day FROM telemetry)
UNION ALL SELECT 'billing_records', COUNT(DISTINCT chunk) FILTER (aged), COUNT(*), COUNT(DISTINCT chunk) FILTER (aged) > 0 FROM (
  SELECT chunk, TIMESTAMP '1970-01-01' + to_days(CAST((chunk + 1) * 7 AS INTEGER)) <= (SELECT max(time) FROM billing_records) - INTERVAL 30 DAY AS aged
  FROM (SELECT epoch_us(time) // 604800000000 AS chunk FROM billing_records)){views}"""


@register("aged_policies", with_views("telemetry", "billing_records", extra="now AS (SELECT max(ts) AS moment FROM events)") + _aged_sql())
def aged_policies(spark, sf_dir):
    """Telemetry, billing and the five stored views rewritten by their ages, with the compression ratio of what was rewritten."""
    base, _ = _scratch(spark, "aged-policies")
    t = tables.telemetry(spark, sf_dir)
    now, paid = t.agg(F.max("time")).first()[0], tables.billing_records(spark, sf_dir).agg(F.max("time")).first()[0]
    telemetry_store.write_telemetry(t.select(*_READING_COLUMNS, "ingested_at"), f"{base}/telemetry")
    telemetry_store.write_billing_records(tables.billing_records(spark, sf_dir), f"{base}/billing")
    stored_views.store_views(t, f"{base}/views", now)
    newest = F.col("time").desc()
    ages = telemetry_store.COMPRESS_AFTER
    jobs = [("telemetry", f"{base}/telemetry", "day", now, ages["telemetry"], [F.col("device_id"), F.col("region"), newest], "day"),
            ("billing_records", f"{base}/billing", "chunk", paid, ages["billing_records"], [F.col("account_id"), newest], "day")]
    jobs += [(f"usage_{v}", f"{base}/views/resolution={v}", "day", now, POLICIES[v][3], [F.col("device_id"), F.col("bucket").desc()], part)
             for v, (_, _, _, part) in _VIEW_STATS.items()]
    out = None
    for name, path, partition, at, age, order, width in jobs:
        report = telemetry_store.compact_aged(spark, path, name, partition, at, age, order, width)
        kept = spark.read.parquet(path).count() if entries(spark, path) else 0
        row = report.select("table_name", "partitions", F.lit(kept).cast("bigint").alias("rows_kept"), F.col("compression_ratio_pct").isNotNull().alias("ratio_known"))
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------- stateful streams


@register("stream_replay_guard", "WITH RECURSIVE " + CLOCK_SQL + f""",
o AS (SELECT event_id, CAST(user_id AS VARCHAR) || ':' || CAST({K} % 10 AS VARCHAR) AS nonce, time_ms,
             row_number() OVER (PARTITION BY user_id, {K} % 10 ORDER BY time_ms, event_id) AS rn FROM clock),
r AS (SELECT nonce, rn, event_id, time_ms, time_ms + 5000 AS expires, false AS replay FROM o WHERE rn = 1
      UNION ALL
      SELECT o.nonce, o.rn, o.event_id, o.time_ms, CASE WHEN r.expires > o.time_ms THEN r.expires ELSE o.time_ms + 5000 END, r.expires > o.time_ms
      FROM r JOIN o ON o.nonce = r.nonce AND o.rn = r.rn + 1)
SELECT event_id, nonce, time_ms, replay FROM r""")
def stream_replay_guard(spark, sf_dir):
    """The exact replay guard with its 5 s window; a nonce leaves the state store when its claim expires."""
    out, ckpt = _scratch(spark, "replay")
    ev = _clock(spark, sf_dir, ckpt + "-src")
    k = F.get_json_object("props", "$.k").cast("int")
    p = ev.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), (k % 10).cast("string")).alias("nonce"), "time_ms", "event_time")
    rows = stateful.stream_fold(p, "nonce", ["time_ms", "event_id"], folds.replay_spec("time_ms"), expires=lambda expires: expires)
    return _run(rows, out, ckpt).drop("event_time")


@register("stream_reorder", ORACLE["reorder_deliver"])
def stream_reorder(spark, sf_dir):
    """The reorder buffer over frames that arrive in several files."""
    out, ckpt = _scratch(spark, "reorder")
    frames = arriving(_frames(spark, sf_dir), ckpt + "-src", F.col("arrival"))
    return _run(stateful.stream_fold(frames, "device_id", ["arrival"], folds.reorder_spec()), out, ckpt)


@register("stream_rate_limit", "WITH RECURSIVE " + CLOCK_SQL + f""",
req AS (SELECT 'gw-' || CAST(user_id % 10 AS VARCHAR) AS device_id, event_id, time_ms AS t, CAST({K} % 100 AS DOUBLE) / 100 AS c,
               [10, 100, 500][CAST(user_id % 10 % 3 AS INTEGER) + 1] AS tier FROM clock),
eager AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM req WHERE c > 0.95),
bursts AS (SELECT device_id, n, t, event_id, t AS began, true AS starts FROM eager WHERE n = 1
           UNION ALL
           SELECT e.device_id, e.n, e.t, e.event_id, CASE WHEN e.t - b.began >= 60000 THEN e.t ELSE b.began END, e.t - b.began >= 60000
           FROM bursts b JOIN eager e ON e.device_id = b.device_id AND e.n = b.n + 1),
sized AS (SELECT r.device_id, r.event_id, r.t, CASE WHEN count(s.t) > 0 THEN 3 ELSE 1 END AS boost, any_value(r.tier) AS tier, any_value(r.c) AS c
          FROM req r LEFT JOIN (SELECT * FROM bursts WHERE starts) s
            ON s.device_id = r.device_id AND (s.t, s.event_id) <= (r.t, r.event_id) AND r.t - s.t < 5000
          GROUP BY r.device_id, r.event_id, r.t),
ready AS (SELECT *, CAST(tier * boost AS DOUBLE) AS cap, CAST(tier AS DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * c) * boost::DOUBLE AS rate,
                 row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM sized),
filled AS (SELECT device_id, n, event_id, t, cap, rate, cap AS before FROM ready WHERE n = 1
           UNION ALL
           SELECT r.device_id, r.n, r.event_id, r.t, r.cap, r.rate,
                  CASE WHEN r.t - f.t >= 3600000 THEN r.cap
                       ELSE least(r.cap, f.before - CASE WHEN f.before >= 1 THEN 1 ELSE 0 END + CAST(r.t - f.t AS DOUBLE) / 1000.0::DOUBLE * r.rate) END
           FROM filled f JOIN ready r ON r.device_id = f.device_id AND r.n = f.n + 1),
spent AS (SELECT *, before - CASE WHEN before >= 1 THEN 1 ELSE 0 END AS after FROM filled)
SELECT device_id, event_id, before >= 1 AS allowed, CAST(floor(after) AS BIGINT) AS tokens_remaining, CAST(cap AS BIGINT) AS max_tokens,
       t + CASE WHEN after < 1 THEN CAST(ceil((1 - after) / rate * 1000) AS BIGINT) ELSE 0 END AS reset_at_ms
FROM spent""")
def stream_rate_limit(spark, sf_dir):
    """The token bucket per gateway at its real rates; an idle gateway leaves the state store after 3600 s."""
    out, ckpt = _scratch(spark, "rate-limit")
    ev = _clock(spark, sf_dir, ckpt + "-src")
    gateway = F.col("user_id") % 10
    tiers = F.array(F.lit("free"), F.lit("standard"), F.lit("enterprise"))
    k = F.get_json_object("props", "$.k").cast("int")
    req = ev.select(F.concat(F.lit("gw-"), gateway.cast("string")).alias("device_id"), "event_id", "time_ms",
                    F.element_at(tiers, (gateway % 3 + 1).cast("int")).alias("billing_tier"), ((k % 100) / 100.0).alias("compliance"), "event_time")
    rows = _run(stateful.stream_fold(req, "device_id", ["time_ms", "event_id"], folds.token_bucket_spec(), expires=folds.bucket_expiry()), out, ckpt)
    return rows.select("device_id", "event_id", "allowed", "tokens_remaining", "max_tokens", "reset_at_ms")


@register("stream_fragments", _FRAGMENTS_SQL + """
UNION ALL SELECT connection_id, pos + 1, 'partial_message_timeout', NULL, buf FROM r
WHERE armed IS NOT NULL AND armed + 30000 < (SELECT max(now_ms) - 1000 FROM c) AND (connection_id, pos) IN (SELECT connection_id, max(pos) FROM c GROUP BY 1)""")
def stream_fragments(spark, sf_dir):
    """Fragment reassembly per connection over several files; a partial message also times out when no chunk follows.

    A connection is in the state store only while a message is incomplete or shortly after it was closed.
    """
    out, ckpt = _scratch(spark, "fragments")
    chunks = _chunks(tables.read_table(spark, sf_dir, "conversations"))
    # a conversation's turns are at the same few times as all others', so a time has a share of the whole input
    d = arriving(chunks, ckpt + "-src", F.col("time_ms"), ties=F.xxhash64("connection_id")).withColumn("event_time", F.timestamp_millis("time_ms")).withWatermark("event_time", "1 second")
    rows = _run(stateful.stream_reassemble(d, timeout_ms=folds.MESSAGE_TIMEOUT_MS, position="turn"), out, ckpt)
    return rows.select("connection_id", "event_pos", "kind", F.length("payload").alias("payload_bytes"), "buffer_bytes")


@register("stream_resync", "WITH RECURSIVE " + CLOCK_SQL + f""",
asked AS (SELECT 'dev-' || CAST(user_id AS VARCHAR) AS entity, time_ms AS t, ['GAP_DETECTED', 'PENDING', 'TENTATIVE', 'GAP_DETECTED'][CAST({K} % 4 AS INTEGER) + 1] AS to_state,
                 row_number() OVER (PARTITION BY user_id ORDER BY time_ms, event_id) AS rn FROM clock),
legal AS (SELECT * FROM (VALUES ('PENDING', 'TENTATIVE'), ('PENDING', 'GAP_DETECTED'), ('TENTATIVE', 'GAP_DETECTED'), ('GAP_DETECTED', 'PENDING')) l(a, b)),
r AS (SELECT DISTINCT entity, CAST(0 AS BIGINT) AS rn, 'PENDING' AS state, CAST(NULL AS BIGINT) AS since, false AS moved, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS t
      FROM asked
      UNION ALL
      SELECT r.entity, a.rn, CASE WHEN l.a IS NULL THEN r.state ELSE a.to_state END,
             CASE WHEN l.a IS NOT NULL THEN CASE WHEN a.to_state = 'GAP_DETECTED' THEN a.t END WHEN a.t - r.since >= 60000 THEN NULL ELSE r.since END,
             l.a IS NOT NULL, CASE WHEN a.t - r.since >= 60000 THEN r.since + 60000 END, a.t
      FROM r JOIN asked a ON a.entity = r.entity AND a.rn = r.rn + 1 LEFT JOIN legal l ON l.a = r.state AND l.b = a.to_state)
SELECT entity, 'transition' AS kind, state, t AS at_ms FROM r WHERE moved
UNION ALL SELECT entity, 'resync_request', 'GAP_DETECTED', due FROM r WHERE due IS NOT NULL
UNION ALL SELECT entity, 'resync_request', 'GAP_DETECTED', since + 60000 FROM r
WHERE since + 60000 < (SELECT max(t) - 10000 FROM asked) AND (entity, rn) IN (SELECT entity, max(rn) FROM asked GROUP BY 1)""")
def stream_resync(spark, sf_dir):
    """Transitions over several files; an entity in GAP_DETECTED for 60 s gives one resync request, by timer if nothing else comes."""
    out, ckpt = _scratch(spark, "resync")
    states = F.array(*[F.lit(x) for x in ("GAP_DETECTED", "PENDING", "TENTATIVE", "GAP_DETECTED")])
    k = F.get_json_object("props", "$.k").cast("int")
    asked = _clock(spark, sf_dir, ckpt + "-src").select(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("entity"), F.get(states, k % 4).alias("to_state"),
                                                        "time_ms", "event_id", "event_time")
    return _run(resync.resync_requests(asked, order=["time_ms", "event_id"]), out, ckpt)


@register("stream_refresh", _rollup_sql("1h"))
def stream_refresh(spark, sf_dir):
    """Readings stored, the touched buckets of the hourly view rebuilt every 100 inserts."""
    out, ckpt = _scratch(spark, "refresh")
    tel = tables.telemetry_from(arriving_events(spark, sf_dir, ckpt + "-src")).select("time", "device_id", "metric_id", "metric_value", "region", "ingested_at")
    sink = srollups.ingest_with_refresh(f"{out}/raw", {"1h": f"{out}/hourly"}, f"{out}/counter", every=100, now=dt.datetime(2024, 2, 1))
    _run_batches(tel, sink, ckpt)
    return spark.read.parquet(f"{out}/hourly").drop("day")


# --------------------------------------------------------------------------- views by their refresh policy


def _arriving_orders(spark, sf_dir, base: str):
    orders = tables.read_table(spark, sf_dir, "orders")
    return arriving(orders, base, F.unix_micros(F.col("o_orderdate").cast("timestamp")))


def _due_sql(rollup: str, width: str, end_offset: str, source: str) -> str:
    """The rows of ``rollup`` that are closed for ``end_offset`` when the latest row has come."""
    return f"SELECT * FROM ({rollup}) WHERE bucket + INTERVAL {width} + INTERVAL {end_offset} <= (SELECT max(time) FROM ({source}))"


@register("stream_usage_due", _due_sql(_rollup_sql("1h"), "1 HOUR", "1 HOUR", "SELECT ts AS time FROM events"))
def stream_usage_due(spark, sf_dir):
    """The hourly view by its policy: a bucket appears an hour after its end, then late readings correct it."""
    out, ckpt = _scratch(spark, "usage-due")
    late = F.get_json_object("props", "$.k").cast("int")
    tel = tables.telemetry_from(arriving_events(spark, sf_dir, ckpt + "-src", late))
    srollups.run_policy_stream(spark, tel, "1h", out, ckpt).awaitTermination()
    return spark.read.parquet(out).drop("day")


@register("stream_usage_1mo", _due_sql("""SELECT date_trunc('month', o_orderdate) AS bucket, 'dev-' || CAST(o_custkey % 150 AS VARCHAR) AS device_id, COUNT(*) AS sample_count,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_value,
       CAST(MIN(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS min_value, CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS max_value,
       MAX(o_orderdate) AS _aggregate_watermark FROM orders GROUP BY 1, 2""", "1 MONTH", "1 MONTH", "SELECT o_orderdate AS time FROM orders"))
def stream_usage_1mo(spark, sf_dir):
    """The monthly view behind daily state; order amounts, which span years, are the readings."""
    out, ckpt = _scratch(spark, "usage-1mo")
    o = _arriving_orders(spark, sf_dir, ckpt + "-src")
    tel = o.select(F.col("o_orderdate").alias("time"), F.concat(F.lit("dev-"), (F.col("o_custkey") % 150).cast("string")).alias("device_id"),
                   F.col("o_totalprice").cast("decimal(18,2)").alias("metric_value"))
    srollups.run_policy_stream(spark, tel, "1mo", out, ckpt).awaitTermination()
    return spark.read.parquet(out).drop("day")


@register("stream_billing_daily", _due_sql(ORACLE["billing_daily"], "1 DAY", "1 DAY", "SELECT o_orderdate AS time FROM orders"))
def stream_billing_daily(spark, sf_dir):
    """The daily billing view by its policy."""
    out, ckpt = _scratch(spark, "billing-daily")
    records = tables.billing_records_from(_arriving_orders(spark, sf_dir, ckpt + "-src"))
    srollups.run_policy_stream(spark, records, "billing_1d", out, ckpt).awaitTermination()
    return spark.read.parquet(out).drop("day")


@register("stream_counter_flush", with_views("telemetry") + """SELECT date_trunc('minute', time) AS flush_minute, tenant_id, region, COUNT(*) AS increments
FROM telemetry GROUP BY 1, 2, 3""")
def stream_counter_flush(spark, sf_dir):
    """Per-label counts per 60 s of event time, updated by micro-batch and merged."""
    out, ckpt = _scratch(spark, "counter")
    tel = tables.telemetry_from(arriving_events(spark, sf_dir, ckpt + "-src"))
    flushed = srollups.counter_flush(tel, ["tenant_id", "region"], watermark="1 hour").withColumnRenamed("flush_minute", "bucket")
    _run_batches(flushed, srollups.merge_rollup(out, ("bucket", "tenant_id", "region")), ckpt, "update")
    return spark.read.parquet(out).select(F.col("bucket").alias("flush_minute"), "tenant_id", "region", "increments")

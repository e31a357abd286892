"""Queries: idempotent sinks, ordered logs, ledger follow-up, batch audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import epoch_ms, time_bucket
from ..operators import analytics, sequence
from ..sources import tables
from .oracle_views import with_views
from .registry import register

# --------------------------------------------------------------------------- event log


def _stored_log(spark, sf_dir) -> DataFrame:
    """Events already in the store: sequence = arrival + 1."""
    return tables.event_log(spark, sf_dir).withColumn("sequence", F.col("arrival") + 1)


@register("insert_ignore", with_views("event_log", extra="""
incoming AS (SELECT tenant_id, arrival + 1 AS sequence, event_type, payload, 0 AS attempt FROM event_log
             UNION ALL
             SELECT tenant_id, arrival + 1, event_type, upper(payload), 1 FROM event_log WHERE arrival % 2 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, sequence ORDER BY attempt) AS rn
                          FROM incoming) WHERE rn = 1),
target AS (SELECT tenant_id, arrival + 1 AS sequence FROM event_log WHERE arrival < 2)""") + """SELECT f.tenant_id, f.sequence, f.event_type, f.payload, f.attempt
FROM firsts f ANTI JOIN target t ON f.tenant_id = t.tenant_id AND f.sequence = t.sequence""")
def insert_ignore(spark, sf_dir):
    """First copy per key, minus keys already stored."""
    log = _stored_log(spark, sf_dir)
    first = log.select("tenant_id", "sequence", "event_type", "payload", F.lit(0).alias("attempt"))
    replay = log.where(F.col("arrival") % 2 == 0).select(
        "tenant_id", "sequence", "event_type", F.upper("payload").alias("payload"), F.lit(1).alias("attempt"))
    target = log.where(F.col("arrival") < 2).select("tenant_id", "sequence")
    out = sequence.insert_ignore(first.unionByName(replay), target, ["tenant_id", "sequence"], order="attempt")
    return out.select("tenant_id", "sequence", "event_type", "payload", "attempt")


@register("event_append", with_views("event_log") + """SELECT i.tenant_id, i.arrival, i.event_type,
       COALESCE(b.base, 0) + row_number() OVER (PARTITION BY i.tenant_id ORDER BY i.arrival) AS sequence
FROM (SELECT * FROM event_log WHERE arrival >= 3) i
LEFT JOIN (SELECT tenant_id, MAX(arrival + 1) AS base FROM event_log WHERE arrival < 3 GROUP BY tenant_id) b
  ON i.tenant_id = b.tenant_id""")
def event_append(spark, sf_dir):
    """Dense per-tenant sequence continuing after the stored maximum."""
    log = _stored_log(spark, sf_dir)
    stored = log.where(F.col("arrival") < 3)
    incoming = log.where(F.col("arrival") >= 3).select("tenant_id", "arrival", "event_type")
    out = sequence.append_sequences(stored, incoming, "tenant_id", ["arrival"],
                                    chunk=F.floor(F.col("arrival") / 100_000))
    return out.select("tenant_id", "arrival", "event_type", "sequence")


@register("event_page", with_views("event_log") + """SELECT tenant_id, sequence, event_type, page_pos FROM (
  SELECT tenant_id, arrival + 1 AS sequence, event_type,
         CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY arrival + 1) AS INTEGER) AS page_pos
  FROM event_log WHERE arrival + 1 > 2) WHERE page_pos <= 3""")
def event_page(spark, sf_dir):
    """The page after cursor 2 (limit 3) for every tenant."""
    log = _stored_log(spark, sf_dir).select("tenant_id", "sequence", "event_type")
    after = log.select("tenant_id").distinct().withColumn("after_seq", F.lit(2))
    return analytics.event_pages(log, after, limit=3).select("tenant_id", "sequence", "event_type", "page_pos")


@register("ledger_page", with_views("ledger") + """SELECT sequence, arrival_ts FROM ledger
WHERE sequence > (SELECT max(sequence) // 2 FROM ledger) ORDER BY sequence LIMIT 100""")
def ledger_page(spark, sf_dir):
    """The page of 100 entries after the cursor in the middle of the ledger, lowest sequences first."""
    log = tables.ledger(spark, sf_dir).select("sequence", "arrival_ts")
    cursor = (log.agg(F.max("sequence")).first()[0] or 0) // 2
    return log.where(F.col("sequence") > cursor).orderBy("sequence").limit(100)


# --------------------------------------------------------------------------- ledger


@register("seq_gaps", with_views("ledger") + """SELECT stream_id, prev + 1 AS expected_seq, sequence AS observed_seq,
       sequence - prev - 1 AS missing_count
FROM (SELECT *, MAX(sequence) OVER (PARTITION BY stream_id ORDER BY arrival_ts, arrival_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM ledger)
WHERE prev IS NOT NULL AND sequence > prev + 1""", bench=True)
def seq_gaps(spark, sf_dir):
    """Forward gaps of the single ledger stream, scanned in hourly chunks."""
    led = tables.ledger(spark, sf_dir)
    return sequence.sequence_gaps(led, chunk=time_bucket("1 hour", "arrival_ts"))


@register("nth_trigger", with_views("telemetry", "billing_records") + """SELECT 'reconcile' AS kind, position, CAST(record_id AS VARCHAR) AS row_key FROM (
  SELECT record_id, row_number() OVER (ORDER BY time, record_id) AS position FROM billing_records) WHERE position % 100 = 0
UNION ALL
SELECT 'refresh', position, CAST(event_id AS VARCHAR) FROM (
  SELECT event_id, row_number() OVER (ORDER BY ingested_at, event_id) AS position FROM telemetry) WHERE position % 1000 = 0""")
def nth_trigger(spark, sf_dir):
    """Every 100th billing transaction triggers a reconcile; every 1000th
    ingested reading a refresh. Global positions by range partitions and their counts."""
    recs = tables.billing_records(spark, sf_dir)
    r = sequence.every_nth(recs.select("record_id", "time"), ["time", "record_id"], 100)
    tel = tables.telemetry(spark, sf_dir)
    t = sequence.every_nth(tel.select("event_id", "ingested_at"), ["ingested_at", "event_id"], 1000)
    return (r.select(F.lit("reconcile").alias("kind"), "position", F.col("record_id").cast("string").alias("row_key"))
             .unionByName(t.select(F.lit("refresh").alias("kind"), "position",
                                   F.col("event_id").cast("string").alias("row_key"))))


@register("ledger_catchup", with_views("ledger", extra="""
b AS (SELECT MIN(sequence) - 1 AS f, MAX(sequence) AS t FROM ledger),
s AS (SELECT gs.generate_series AS seq, b.f FROM b, generate_series(b.f + 1, LEAST(b.t, b.f + 172800)) gs),
j AS (SELECT s.seq, s.f, l.sequence IS NOT NULL AS have FROM s LEFT JOIN (SELECT DISTINCT sequence FROM ledger) l ON s.seq = l.sequence),
g AS (SELECT CAST(floor((seq - (f + 1)) / 10) AS BIGINT) AS batch_no, MIN(seq) AS batch_start, MAX(seq) AS batch_end,
             COUNT(*) FILTER (WHERE NOT have) AS failed_count FROM j GROUP BY 1)""") + """SELECT batch_no, batch_start, batch_end, failed_count, batch_end AS last_synced_ledger,
       floor(batch_end / 64) > floor((batch_start - 1) / 64)
         OR batch_end = (SELECT LEAST(t, f + 172800) FROM b) AS checkpoint,
       (SELECT CAST(GREATEST(t - f - 172800, 0) AS BIGINT) FROM b) AS left_over
FROM g""")
def ledger_catchup(spark, sf_dir):
    """Catch-up batches from the first to the last ledger; gaps are failed ledgers."""
    led = tables.ledger(spark, sf_dir)
    bounds = led.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
    return sequence.catchup_plan(spark, led, int(bounds["lo"]) - 1, int(bounds["hi"]))


@register("ledger_lag", with_views("ledger", extra="""
h AS (SELECT date_trunc('hour', arrival_ts) AS poll_hour, MAX(sequence) AS m FROM ledger GROUP BY 1),
p AS (SELECT poll_hour,
             MAX(m) OVER (ORDER BY poll_hour) AS latest_polled,
             MAX(m) OVER (ORDER BY poll_hour RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 HOUR PRECEDING) AS last_synced
      FROM h)""") + """SELECT poll_hour, latest_polled, last_synced,
       CASE WHEN latest_polled IS NULL THEN NULL ELSE GREATEST(0, latest_polled - COALESCE(last_synced, 0)) END AS lag
FROM p""")
def ledger_lag(spark, sf_dir):
    """Hourly polls; the synchronizer persists what was polled two hours earlier."""
    led = tables.ledger(spark, sf_dir)
    hourly = led.groupBy(time_bucket("1 hour", "arrival_ts").alias("poll_hour")).agg(F.max("sequence").alias("m"))
    # The window runs over one row per hour (a bounded summary), not over ledger rows.
    secs = F.unix_seconds(F.col("poll_hour").cast("timestamp"))
    w_all = Window.orderBy(secs).rangeBetween(Window.unboundedPreceding, 0)
    w_two = Window.orderBy(secs).rangeBetween(Window.unboundedPreceding, -7200)
    polls = hourly.select("poll_hour", F.max("m").over(w_all).alias("latest_polled"),
                          F.max("m").over(w_two).alias("last_synced"))
    return sequence.ledger_lag(polls)


def _pages(led: DataFrame) -> DataFrame:
    return led.select("sequence", F.expr(
        "transform(array_repeat(0, cast(sequence % 4 as int)), (x, i) -> sha2(concat(cast(sequence as string), ':', cast(i as string)), 256))"
    ).alias("transactions"))


@register("ledger_tx_ops", with_views("ledger", extra="""
tx AS (SELECT sequence, i AS tx_index, sha256(CAST(sequence AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS tx_hash
       FROM ledger, range(CAST(sequence % 4 AS INTEGER)) r(i)),
known AS (SELECT tx_hash, (sequence + tx_index) % 5 AS n_ops FROM tx WHERE (sequence + tx_index) % 7 <> 0)""") + """SELECT tx.sequence, CAST(tx.tx_index AS INTEGER) AS tx_index, tx.tx_hash, CAST(k.n_ops AS INTEGER) AS op_count
FROM tx LEFT JOIN known k ON tx.tx_hash = k.tx_hash""")
def ledger_tx_ops(spark, sf_dir):
    """Ledger pages to transactions with their operation counts."""
    pages = _pages(tables.ledger(spark, sf_dir))
    tx = pages.select("sequence", F.posexplode("transactions").alias("tx_index", "tx_hash"))
    known = (tx.where((F.col("sequence") + F.col("tx_index")) % 7 != 0)
               .select("tx_hash", F.expr("array_repeat('op', cast((sequence + tx_index) % 5 as int))").alias("operations")))
    return sequence.ledger_transactions(pages, known)


# --------------------------------------------------------------------------- batches


def _batches(spark, sf_dir) -> DataFrame:
    tel = tables.telemetry(spark, sf_dir)
    ms = epoch_ms("time")
    start_ms = ms - F.pmod(ms, F.lit(300000))
    b = tel.select("device_id", start_ms.alias("start_ms")).distinct()
    start = F.timestamp_millis("start_ms").cast("timestamp_ntz")
    return b.select(F.concat_ws(":", "device_id", F.col("start_ms").cast("string")).alias("id"), "device_id",
                    start.alias("batch_start"), (start + F.expr("INTERVAL 5 MINUTES")).alias("batch_end"),
                    F.when(start >= F.lit("2024-01-29").cast("timestamp_ntz"), "OPEN").otherwise("CLOSED").alias("state"))


_BATCHES_SQL = """b0 AS (SELECT DISTINCT device_id, (epoch_us(time) // 1000) - (epoch_us(time) // 1000) % 300000 AS start_ms FROM telemetry),
batches AS (SELECT device_id || ':' || CAST(start_ms AS VARCHAR) AS id, device_id,
                   make_timestamp(start_ms * 1000) AS batch_start,
                   make_timestamp(start_ms * 1000) + INTERVAL 5 MINUTE AS batch_end,
                   CASE WHEN make_timestamp(start_ms * 1000) >= TIMESTAMP '2024-01-29' THEN 'OPEN' ELSE 'CLOSED' END AS state
            FROM b0)"""


@register("open_batch", with_views("telemetry", extra=_BATCHES_SQL) + """SELECT device_id, id, batch_start, batch_end, state FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY batch_start DESC) AS rn FROM batches WHERE state = 'OPEN')
WHERE rn = 1""")
def open_batch(spark, sf_dir):
    """Latest OPEN batch per device."""
    return sequence.open_batches(_batches(spark, sf_dir)).select("device_id", "id", "batch_start", "batch_end", "state")


@register("batch_contiguity", with_views("telemetry", extra=_BATCHES_SQL) + """SELECT device_id, id, batch_start, batch_end, next_start,
       CASE WHEN next_start IS NULL THEN 'last' WHEN next_start = batch_end THEN 'contiguous'
            WHEN next_start > batch_end THEN 'gap' ELSE 'overlap' END AS status
FROM (SELECT * REPLACE (CASE WHEN CAST(replace(device_id, 'dev-', '') AS BIGINT) % 7 = 3 THEN batch_start + INTERVAL 1 DAY ELSE batch_end END AS batch_end),
             lead(batch_start) OVER (PARTITION BY device_id ORDER BY batch_start) AS next_start FROM batches)""")
def batch_contiguity(spark, sf_dir):
    """Successor of each batch; chunked by day so a hot device stays parallel. Every seventh device closes its batches a day late."""
    late = F.regexp_replace("device_id", "dev-", "").cast("bigint") % 7 == 3
    end = F.when(late, F.col("batch_start") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("batch_end"))
    return sequence.batch_contiguity(_batches(spark, sf_dir).withColumn("batch_end", end), chunk=time_bucket("1 day", "batch_start"))

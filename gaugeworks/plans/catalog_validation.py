"""Queries: ingest validation, tiering, state machines, audits and helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebuckets import epoch_ms, time_bucket
from ..operators import validation as V
from ..sources import batches, tables
from .oracle_views import K, with_views
from .registry import register

# --------------------------------------------------------------------------- payload checks


@register("stale_filter", with_views("payloads") + """SELECT event_id, nonce, ts_ms, received_ms
FROM payloads WHERE abs(received_ms - ts_ms) <= 5000""")
def stale_filter(spark, sf_dir):
    """P5: payloads inside the 5 s freshness window (5000 ms passes)."""
    p = tables.payloads(spark, sf_dir)
    return p.where(V.is_fresh(F.col("ts_ms"), F.col("received_ms"))).select("event_id", "nonce", "ts_ms", "received_ms")


_METRIC_NAMES = "['temperature', 'humidity', 'voltage', 'energy_kwh', 'pressure']"


@register("metric_out_of_range", with_views("telemetry", extra="""
ranges AS (SELECT * FROM (VALUES ('temperature', -50, 150), ('humidity', 0, 100), ('voltage', 0, 500),
                                 ('energy_kwh', 0, 1000000)) r(metric_name, lower_bound, upper_bound))""") + f"""SELECT t.event_id, r.metric_name, t.metric_value - 100 AS value,
       CAST(r.lower_bound AS BIGINT) AS lower_bound, CAST(r.upper_bound AS BIGINT) AS upper_bound
FROM telemetry t JOIN ranges r ON {_METRIC_NAMES}[t.metric_id] = r.metric_name
WHERE t.metric_value - 100 < r.lower_bound OR t.metric_value - 100 > r.upper_bound""")
def metric_out_of_range(spark, sf_dir):
    """P10: readings outside their metric's bounds (bounded 4-row range table, broadcast)."""
    t = tables.telemetry(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("temperature", "humidity", "voltage", "energy_kwh", "pressure")])
    r = t.select("event_id", F.element_at(names, F.col("metric_id")).alias("metric_name"),
                 (F.col("metric_value") - 100).alias("value"))
    return V.out_of_range(r, V.metric_range_table(spark)).select(
        "event_id", "metric_name", "value", "lower_bound", "upper_bound")


@register("event_valid", with_views("telemetry") + """SELECT event_id, metric_id * 250 AS event_type,
       (epoch_us(time) // 1000000) - 1704070800 AS "timestamp",
       metric_id * 250 < 1000 AND (epoch_us(time) // 1000000) - 1704070800 > 0 AS valid
FROM telemetry""")
def event_valid(spark, sf_dir):
    """Contract event check ``event_type < 1000 and timestamp > 0``."""
    t = tables.telemetry(spark, sf_dir)
    et = F.col("metric_id") * 250
    ts = F.unix_seconds(F.col("time").cast("timestamp")) - F.lit(1704070800)
    return t.select("event_id", et.alias("event_type"), ts.alias("timestamp"),
                    V.contract_event_valid(et, ts).alias("valid"))


@register("tenant_scope", """SELECT c_custkey, tenant_raw,
       CASE WHEN length(substr(regexp_replace(tenant_raw, '[^a-zA-Z0-9_]', '', 'g'), 1, 48)) = 0 THEN NULL
            ELSE 'tenant_' || substr(regexp_replace(tenant_raw, '[^a-zA-Z0-9_]', '', 'g'), 1, 48) END AS schema_name
FROM (SELECT c_custkey,
             CASE WHEN c_custkey % 97 = 0 THEN '#-# !'
                  WHEN c_custkey % 13 = 0 THEN c_name || ' / long-suffix: ' || c_name || '__' || c_name
                  ELSE c_name END AS tenant_raw
      FROM customer)""")
def tenant_scope(spark, sf_dir):
    """Tenant schema names; an id that sanitizes to empty is invalid (NULL)."""
    c = tables.read_table(spark, sf_dir, "customer")
    raw = (F.when(F.col("c_custkey") % 97 == 0, F.lit("#-# !"))
            .when(F.col("c_custkey") % 13 == 0,
                  F.concat("c_name", F.lit(" / long-suffix: "), "c_name", F.lit("__"), "c_name"))
            .otherwise(F.col("c_name")))
    d = c.select("c_custkey", raw.alias("tenant_raw"))
    return d.select("c_custkey", "tenant_raw", V.tenant_schema_name(F.col("tenant_raw")).alias("schema_name"))


@register("cert_verdict", """WITH certs AS (
  SELECT 'SN' || CAST(c_custkey AS VARCHAR) AS serial, 'dev-' || CAST(c_custkey % 150 AS VARCHAR) AS device_id,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_nationkey * 10 AS INTEGER)) AS valid_from,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_nationkey * 10 + c_custkey % 400 AS INTEGER)) AS valid_to,
         c_custkey
  FROM customer),
wl AS (SELECT 'SN' || CAST(c_custkey AS VARCHAR) AS serial, c_custkey % 11 = 0 AS revoked
       FROM customer WHERE c_custkey % 3 <> 0),
v AS (SELECT c.serial, c.device_id,
             CASE WHEN c.valid_from > TIMESTAMP '2024-06-01' OR c.valid_to < TIMESTAMP '2024-06-01'
                    THEN 'Certificate is outside validity window'
                  WHEN wl.serial IS NULL THEN 'Serial ' || c.serial || ' not found in hardware whitelist'
                  WHEN wl.revoked THEN 'Certificate revoked in database' END AS reason
      FROM certs c LEFT JOIN wl ON c.serial = wl.serial)
SELECT serial, device_id, reason IS NULL AS verified, reason FROM v""")
def cert_verdict(spark, sf_dir):
    """Certificate verdicts joined to the hardware whitelist."""
    c = tables.read_table(spark, sf_dir, "customer")
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    certs = c.select(F.concat(F.lit("SN"), F.col("c_custkey").cast("string")).alias("serial"),
                     F.concat(F.lit("dev-"), (F.col("c_custkey") % 150).cast("string")).alias("device_id"),
                     (base + F.make_dt_interval(days=(F.col("c_nationkey") * 10).cast("int"))).alias("valid_from"),
                     (base + F.make_dt_interval(days=(F.col("c_nationkey") * 10 + F.col("c_custkey") % 400).cast("int")))
                     .alias("valid_to"))
    wl = c.where(F.col("c_custkey") % 3 != 0).select(
        F.concat(F.lit("SN"), F.col("c_custkey").cast("string")).alias("serial"),
        (F.col("c_custkey") % 11 == 0).alias("revoked"))
    return V.cert_verdict(certs, wl, F.lit("2024-06-01").cast("timestamp_ntz"))


@register("tx_outcome", with_views("billing_records", extra="""
first_err AS (SELECT record_id AS tx_id, status, record_id,
                     CASE WHEN status = 'failed' AND record_id % 3 = 0 THEN 'tx_BAD_SEQ: sequence mismatch'
                          WHEN status = 'failed' THEN 'tx_insufficient_fee'
                          WHEN status = 'pending' AND record_id % 5 = 0 THEN 'TX_BAD_SEQ'
                          ELSE NULL END AS error FROM billing_records),
log AS (SELECT tx_id, 1 AS attempt, error FROM first_err
        UNION ALL
        SELECT tx_id, 2, CASE WHEN record_id % 2 = 0 THEN 'tx_bad_seq' ELSE NULL END FROM first_err
        WHERE regexp_matches(error, '(?i)tx_bad_seq')),
g0 AS (SELECT tx_id, COUNT(*) AS attempts, MAX(attempt) AS a FROM log GROUP BY tx_id),
g AS (SELECT g0.tx_id, g0.attempts, log.error AS last_error FROM g0 JOIN log ON g0.tx_id = log.tx_id AND g0.a = log.attempt)""") + """SELECT g.tx_id, g.attempts,
       CASE WHEN last_error IS NULL AND f.status = 'settled' THEN 'confirmed'
            WHEN last_error IS NULL THEN 'submitted' ELSE 'failed' END AS status,
       CASE WHEN last_error IS NULL THEN NULL
            WHEN regexp_matches(last_error, '(?i)tx_bad_seq') THEN 'ERR:' || last_error ELSE last_error END AS error
FROM g JOIN first_err f ON g.tx_id = f.tx_id""")
def tx_outcome(spark, sf_dir):
    """Submission outcome with one retry of a bad-sequence error."""
    r = tables.billing_records(spark, sf_dir)
    first = r.select(F.col("record_id").alias("tx_id"), "record_id",
                     F.when((F.col("status") == "failed") & (F.col("record_id") % 3 == 0), F.lit("tx_BAD_SEQ: sequence mismatch"))
                      .when(F.col("status") == "failed", F.lit("tx_insufficient_fee"))
                      .when((F.col("status") == "pending") & (F.col("record_id") % 5 == 0), F.lit("TX_BAD_SEQ"))
                      .alias("error"))
    log = V.retry_attempts(first, F.when(F.col("record_id") % 2 == 0, F.lit("tx_bad_seq")))
    conf = r.where(F.col("status") == "settled").select(F.col("record_id").alias("tx_id"))
    return V.tx_outcome(log, conf)


@register("agg_freshness", with_views("telemetry") + """SELECT device_id, MAX(time) AS last_refresh,
       CAST(floor((epoch_us((SELECT MAX(time) FROM telemetry)) - epoch_us(MAX(time))) / 1000) AS BIGINT) AS age_ms,
       CAST(floor((epoch_us((SELECT MAX(time) FROM telemetry)) - epoch_us(MAX(time))) / 1000) AS BIGINT) <= 7200000 AS fresh
FROM telemetry GROUP BY device_id""")
def agg_freshness(spark, sf_dir):
    """P20: per-device rollup watermark against the newest reading (2 h limit, inclusive)."""
    t = tables.telemetry(spark, sf_dir)
    per = t.groupBy("device_id").agg(F.max("time").alias("last_refresh"))
    # ``now`` is one value (the newest reading), fetched once and used as a literal.
    now = t.agg(F.max("time")).first()[0]
    age, fresh = V.freshness(F.col("last_refresh"), F.lit(now).cast("timestamp_ntz"))
    return per.select("device_id", "last_refresh", age.alias("age_ms"), fresh.alias("fresh"))


# --------------------------------------------------------------------------- hashing and sampling


@register("hash_jitter", with_views("telemetry") + """SELECT event_id,
       CAST(('0x' || substr(sha256('session-' || CAST(user_id AS VARCHAR) || ':v' || CAST(k % 3 AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
       CASE WHEN (k % 5) * 30 - 30 <= 0 THEN CAST(3600 AS BIGINT)
            ELSE 3600 + CAST(floor(CAST(('0x' || substr(sha256('session-' || CAST(user_id AS VARCHAR) || ':v' || CAST(k % 3 AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * ((k % 5) * 30 - 30 + 1)) AS BIGINT) END AS ttl_seconds
FROM telemetry""")
def hash_jitter(spark, sf_dir):
    """stable unit interval per session and the jittered token lifetime."""
    t = tables.telemetry(spark, sf_dir)
    seed = F.concat(F.lit("session-"), F.col("user_id").cast("string"), F.lit(":v"), (F.col("k") % 3).cast("string"))
    u = V.hash_unit_interval(seed)
    jitter = (F.col("k") % 5) * 30 - 30
    return t.select("event_id", u.alias("u"), V.jittered_ttl(F.lit(3600).cast("bigint"), jitter, u).alias("ttl_seconds"))


@register("rule_sample", with_views("telemetry", extra="""
spans AS (SELECT event_id, 'trace-' || CAST(event_id AS VARCHAR) AS trace_id,
                 CASE event_type WHEN 'purchase' THEN 'blockchain' WHEN 'signup' THEN 'billing' ELSE 'telemetry' END AS domain,
                 k % 3 AS priority,
                 CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN 'billing_finalize' ELSE 'other' END AS operation
          FROM telemetry)""") + """SELECT event_id, trace_id, domain, priority, operation FROM spans
WHERE domain = 'blockchain' OR priority = 2 OR operation = 'billing_finalize'
   OR CAST(('0x' || substr(sha256(trace_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1""")
def rule_sample(spark, sf_dir):
    """Rule-based span sampling with a stable 10 % baseline."""
    t = tables.telemetry(spark, sf_dir)
    et = F.col("event_type")
    spans = t.select("event_id", F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
                     F.when(et == "purchase", "blockchain").when(et == "signup", "billing").otherwise("telemetry").alias("domain"),
                     (F.col("k") % 3).alias("priority"),
                     F.when((et == "signup") & (F.col("k") % 4 == 0), "billing_finalize").otherwise("other").alias("operation"))
    return spans.where(V.keep_span(F.col("domain"), F.col("priority"), F.col("operation"), F.col("trace_id")))


# --------------------------------------------------------------------------- tiers

_TIER_VERSIONS = [
    ("v1-default", "1970-01-01 00:00:00", V.DEFAULT_TIERS),
    ("v2", "2024-01-10 00:00:00", [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 50000.0), ("TIER_3", 10001.0, None)]),
    ("v3", "2024-01-20 00:00:00", [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 1500.0), ("TIER_3", 10001.0, None)]),
]


def _tier_sql(v: str, t2max: str) -> str:
    return f"""CASE WHEN {v} >= 0 AND {v} <= 1000 THEN 'TIER_1'
            WHEN {v} >= 1001 AND {v} <= {t2max} THEN 'TIER_2'
            WHEN {v} >= 10001 THEN 'TIER_3' ELSE 'UNKNOWN_TIER' END"""


@register("tier_assign", with_views("telemetry") + f"""SELECT event_id, CAST(metric_value * 25 AS DOUBLE) AS value, 'default' AS version_id,
       {_tier_sql('CAST(metric_value * 25 AS DOUBLE)', '10000')} AS tier
FROM telemetry""")
def tier_assign(spark, sf_dir):
    """First matching tier of the pinned default config, else UNKNOWN_TIER."""
    t = tables.telemetry(spark, sf_dir)
    r = t.select("event_id", (F.col("metric_value") * 25).cast("double").alias("value"))
    return V.assign_tier(r, V.DEFAULT_TIERS)


@register("tier_asof", with_views("telemetry") + f"""SELECT event_id, time, CAST(metric_value * 25 AS DOUBLE) AS value,
       CASE WHEN time >= TIMESTAMP '2024-01-20' THEN 'v3' WHEN time >= TIMESTAMP '2024-01-10' THEN 'v2' ELSE 'v1-default' END AS version_id,
       CASE WHEN time >= TIMESTAMP '2024-01-20' THEN {_tier_sql('CAST(metric_value * 25 AS DOUBLE)', '1500')}
            WHEN time >= TIMESTAMP '2024-01-10' THEN {_tier_sql('CAST(metric_value * 25 AS DOUBLE)', '50000')}
            ELSE {_tier_sql('CAST(metric_value * 25 AS DOUBLE)', '10000')} END AS tier
FROM telemetry""")
def tier_asof(spark, sf_dir):
    """As-of join of readings to the config version valid at their time."""
    import datetime as dt
    t = tables.telemetry(spark, sf_dir)
    r = t.select("event_id", "time", (F.col("metric_value") * 25).cast("double").alias("value"))
    versions = V.tier_versions(spark, [(v, dt.datetime.fromisoformat(vf), tiers) for v, vf, tiers in _TIER_VERSIONS])
    return V.assign_tier_asof(r, versions).select("event_id", "time", "value", "version_id", "tier")


def _version_sql(t: str) -> str:
    return f"CASE WHEN {t} >= TIMESTAMP '2024-01-20' THEN 'v3' WHEN {t} >= TIMESTAMP '2024-01-10' THEN 'v2' ELSE 'v1-default' END"


@register("tier_batch_pinned", with_views("telemetry", extra=f"""
b AS (SELECT date_trunc('day', ingested_at + INTERVAL 12 HOUR) AS batch_start, MIN(time) AS t0, MAX(time) AS t1 FROM telemetry GROUP BY 1),
bv AS (SELECT batch_start, {_version_sql('t0')} AS start_version, {_version_sql('t1')} AS version_id FROM b)""") + f"""SELECT t.event_id, bv.batch_start, CAST(t.metric_value * 25 AS DOUBLE) AS value, bv.version_id,
       CASE bv.version_id WHEN 'v3' THEN {_tier_sql('CAST(t.metric_value * 25 AS DOUBLE)', '1500')}
                          WHEN 'v2' THEN {_tier_sql('CAST(t.metric_value * 25 AS DOUBLE)', '50000')}
                          ELSE {_tier_sql('CAST(t.metric_value * 25 AS DOUBLE)', '10000')} END AS tier,
       bv.start_version <> bv.version_id AS transitioned
FROM telemetry t JOIN bv ON date_trunc('day', t.ingested_at + INTERVAL 12 HOUR) = bv.batch_start""")
def tier_batch_pinned(spark, sf_dir):
    """Readings processed in daily ingestion batches from noon to noon, each tiered under
    one config version (redone under the newer version when the version
    changed at a midnight between the batch's first and last reading)."""
    import datetime as dt
    t = tables.telemetry(spark, sf_dir)
    half_day = F.col("ingested_at") + F.make_dt_interval(hours=F.lit(12))
    r = t.select("event_id", time_bucket("1d", half_day).alias("batch_start"), "time",
                 (F.col("metric_value") * 25).cast("double").alias("value"))
    versions = V.tier_versions(spark, [(v, dt.datetime.fromisoformat(vf), tiers) for v, vf, tiers in _TIER_VERSIONS])
    out = V.assign_tier_per_batch(r, versions, batch="batch_start")
    return out.select("event_id", "batch_start", "value", "version_id", "tier", "transitioned")


# --------------------------------------------------------------------------- state machines

_ING = "['PENDING', 'TENTATIVE', 'SETTLED', 'ROLLED_BACK', 'RECONCILING', 'FAILED', 'GAP_DETECTED']"
_CYC = "['OPEN', 'FINALIZING', 'FINALIZED', 'SETTLED']"


def _history(spark, sf_dir) -> DataFrame:
    """Transition requests: ingestion machine per device, billing-cycle machine per cycle."""
    t = tables.telemetry(spark, sf_dir)
    ing = F.array(*[F.lit(s) for s in V.INGESTION_STATES])
    cyc = F.array(*[F.lit(s) for s in ("OPEN", "FINALIZING", "FINALIZED", "SETTLED")])
    a = t.select(F.lit("ingestion").alias("machine"), F.col("device_id").alias("entity"), F.col("event_id").alias("seq"),
                 F.element_at(ing, (F.col("k") % 7 + 1).cast("int")).alias("from_state"),
                 F.element_at(ing, ((F.col("k") * 3 + F.col("metric_id")) % 7 + 1).cast("int")).alias("to_state"))
    r = tables.billing_records(spark, sf_dir)
    b = r.select(F.lit("billing_cycle").alias("machine"), F.col("account_id").alias("entity"), F.col("record_id").alias("seq"),
                 F.element_at(cyc, (F.col("record_id") % 4 + 1).cast("int")).alias("from_state"),
                 F.element_at(cyc, (F.floor(F.col("record_id") / 4) % 4 + 1).cast("int")).alias("to_state"))
    return a.unionByName(b)


_HISTORY_SQL = f"""history AS (
  SELECT 'ingestion' AS machine, device_id AS entity, event_id AS seq,
         {_ING}[k % 7 + 1] AS from_state, {_ING}[(k * 3 + metric_id) % 7 + 1] AS to_state FROM telemetry
  UNION ALL
  SELECT 'billing_cycle', account_id, record_id, {_CYC}[record_id % 4 + 1], {_CYC}[CAST(floor(record_id / 4) AS BIGINT) % 4 + 1]
  FROM billing_records),
allowed AS (SELECT * FROM (VALUES
  ('ingestion', 'PENDING', 'TENTATIVE'), ('ingestion', 'PENDING', 'FAILED'), ('ingestion', 'PENDING', 'GAP_DETECTED'),
  ('ingestion', 'TENTATIVE', 'SETTLED'), ('ingestion', 'TENTATIVE', 'ROLLED_BACK'), ('ingestion', 'TENTATIVE', 'FAILED'),
  ('ingestion', 'TENTATIVE', 'GAP_DETECTED'), ('ingestion', 'ROLLED_BACK', 'RECONCILING'),
  ('ingestion', 'RECONCILING', 'PENDING'), ('ingestion', 'RECONCILING', 'FAILED'),
  ('ingestion', 'GAP_DETECTED', 'PENDING'), ('ingestion', 'GAP_DETECTED', 'FAILED'),
  ('billing_cycle', 'OPEN', 'FINALIZING'), ('billing_cycle', 'FINALIZING', 'FINALIZED'),
  ('billing_cycle', 'FINALIZED', 'SETTLED'),
  ('batch', 'OPEN', 'COMPACTING'), ('batch', 'COMPACTING', 'CLOSED')) a(machine, from_state, to_state))"""


@register("illegal_transitions", with_views("telemetry", "billing_records", extra=_HISTORY_SQL) + """SELECT h.machine, h.entity, h.seq, h.from_state, h.to_state
FROM history h ANTI JOIN allowed a ON h.machine = a.machine AND h.from_state = a.from_state AND h.to_state = a.to_state""")
def illegal_transitions(spark, sf_dir):
    """Requests that are not legal transitions (anti join to the fixed table)."""
    return V.illegal_transitions(_history(spark, sf_dir), V.transition_table(spark))


@register("state_audit", with_views("telemetry", "billing_records", extra=_HISTORY_SQL) + """SELECT h.machine, h.entity, h.seq, h.from_state, h.to_state, a.machine IS NOT NULL AS legal,
       h.from_state = COALESCE(lag(h.to_state) OVER (PARTITION BY h.machine, h.entity ORDER BY h.seq),
                               CASE h.machine WHEN 'ingestion' THEN 'PENDING' ELSE 'OPEN' END) AS consistent
FROM history h LEFT JOIN allowed a ON h.machine = a.machine AND h.from_state = a.from_state AND h.to_state = a.to_state""")
def state_audit(spark, sf_dir):
    """Legality and continuity of each recorded step (chunked lag)."""
    return V.audit_history(_history(spark, sf_dir), V.transition_table(spark),
                           chunk=F.floor(F.col("seq") / 100_000))


# --------------------------------------------------------------------------- nested batches


def _batch_docs(spark, sf_dir) -> DataFrame:
    """One batch document per event, built as JSON text (with bad fields)."""
    t = tables.telemetry(spark, sf_dir)
    ms = epoch_ms("time")
    reading = F.expr(
        """transform(array_repeat(0, cast(k % 4 as int)), (x, i) -> concat(
             '{"metricId":"', case when (k + i) % 29 = 0 then '' else concat(event_type, '-', cast(i as string)) end,
             '","value":', case when (k + i) % 37 = 0 then '1e999'
                                else cast(cast(metric_value as decimal(10,2)) + i as string) end,
             ',"unit":"', case when (k + i) % 53 = 0 then '' else 'u' end,
             '","recordedAt":', case when (k + i) % 41 = 0 then '-1' when (k + i) % 43 = 0 then '1.5'
                                     else cast(__ms as string) end, '}'))""")
    doc = F.concat(F.lit('{"telemetry":{"batchId":"'),
                   F.when(F.col("k") % 47 == 0, F.lit("")).otherwise(F.concat(F.lit("b-"), F.col("event_id").cast("string"))),
                   F.lit('","devices":[{"deviceId":"'),
                   F.when(F.col("k") % 31 == 0, F.lit("")).otherwise(F.col("device_id")),
                   F.lit('","readings":['), F.concat_ws(",", reading), F.lit("]}]}}"))
    return t.withColumn("__ms", ms).select("event_id", doc.alias("doc"))


_READINGS_SQL = f"""rd AS (
  SELECT event_id, k, CASE WHEN k % 47 = 0 THEN '' ELSE 'b-' || CAST(event_id AS VARCHAR) END AS batch_id,
         CASE WHEN k % 31 = 0 THEN '' ELSE device_id END AS device_id, i AS reading_index,
         CASE WHEN (k + i) % 29 = 0 THEN '' ELSE event_type || '-' || CAST(i AS VARCHAR) END AS metric_id,
         CASE WHEN (k + i) % 37 = 0 THEN CAST('inf' AS DOUBLE)
              ELSE CAST(CAST(metric_value AS DECIMAL(10,2)) + i AS DOUBLE) END AS value,
         CASE WHEN (k + i) % 53 = 0 THEN '' ELSE 'u' END AS unit,
         CASE WHEN (k + i) % 41 = 0 THEN -1.0 WHEN (k + i) % 43 = 0 THEN 1.5
              ELSE CAST((epoch_us(time) // 1000) AS DOUBLE) END AS recorded_at
  FROM telemetry, range(CAST(k % 4 AS INTEGER)) r(i))"""


@register("batch_flatten", with_views("telemetry", extra=_READINGS_SQL) + """SELECT batch_id, 0 AS device_index, device_id, CAST(reading_index AS INTEGER) AS reading_index,
       metric_id, value, unit, recorded_at FROM rd""")
def batch_flatten(spark, sf_dir):
    """Parse nested batch JSON and flatten to readings."""
    return batches.flatten(batches.parse_batches(_batch_docs(spark, sf_dir)))


def _reading(**fields) -> str:
    """JSON of a sound reading with fields replaced by JSON text, or left out with None."""
    base = {"metricId": '"m"', "value": "1.5", "unit": '"u"', "recordedAt": "7"} | fields
    return "{" + ",".join(f'"{k}":{v}' for k, v in base.items() if v is not None) + "}"


def _document(*readings: str, device: str = '"d"') -> str:
    return f'{{"telemetry":{{"batchId":"b","devices":[{{"deviceId":{device},"readings":[{",".join(readings)}]}}]}}}}'


_R0 = "telemetry.devices[0].readings[0]"
_MIN = "String must contain at least 1 character(s)"


def _typed(path: str, expected: str, received: str) -> tuple:
    return path, "invalid_type", "Required" if received == "undefined" else f"Expected {expected}, received {received}", received


# Documents with every fault (written for event ids by remainder 100) and the
# issues each must give, in order, stated by hand from the validation rules.
_FAULTY: dict[int, tuple[str, list[tuple]]] = {
    1: ("not json", [_typed("(root)", "object", "undefined")]),
    2: ("[1]", [_typed("(root)", "object", "array")]),
    3: ("null", [_typed("(root)", "object", "null")]),
    4: ("{}", [_typed("telemetry", "object", "undefined")]),
    5: ('{"telemetry":7}', [_typed("telemetry", "object", "number")]),
    6: ('{"telemetry":{}}', [_typed("telemetry.batchId", "string", "undefined"), _typed("telemetry.devices", "array", "undefined")]),
    7: ('{"telemetry":{"batchId":null,"devices":{}}}', [_typed("telemetry.batchId", "string", "null"), _typed("telemetry.devices", "array", "object")]),
    8: ('{"telemetry":{"batchId":"","devices":[3,null,{}]}}', [
        ("telemetry.batchId", "too_small", _MIN, None), _typed("telemetry.devices[0]", "object", "number"),
        _typed("telemetry.devices[1]", "object", "null"), _typed("telemetry.devices[2].deviceId", "string", "undefined"),
        _typed("telemetry.devices[2].readings", "array", "undefined")]),
    9: (_document("true", device="null"), [_typed("telemetry.devices[0].deviceId", "string", "null"), _typed(_R0, "object", "boolean")]),
    10: (_document(_reading(metricId="5", value='"x"', unit="false", recordedAt='"x"')), [
        _typed(f"{_R0}.metricId", "string", "number"), _typed(f"{_R0}.value", "number", "string"),
        _typed(f"{_R0}.unit", "string", "boolean"), _typed(f"{_R0}.recordedAt", "number", "string")]),
    11: (_document("{}"), [_typed(f"{_R0}.{f}", "", "undefined") for f in ("metricId", "value", "unit", "recordedAt")]),
    12: (_document(_reading(value="1e999", recordedAt="-1.5")), [
        (f"{_R0}.value", "not_finite", "Number must be finite", None),
        (f"{_R0}.recordedAt", "invalid_type", "Expected integer, received float", "float"),
        (f"{_R0}.recordedAt", "too_small", "Number must be greater than or equal to 0", None)]),
    13: ('{"telemetry":{"batchId":"b","devices":[' + ",".join(['{"deviceId":"d","readings":[]}'] * 101) + "]}}", [
        ("telemetry.devices", "too_big", "Array must contain at most 100 element(s)", None)]),
    14: (_document(*[_reading()] * 51), [("telemetry.devices[0].readings", "too_big", "Array must contain at most 50 element(s)", None)]),
    15: (_document(*[_reading(metricId='""', unit='""', recordedAt="-1")] * 50), [
        (f"telemetry.devices[0].readings[{i}].{f}", "too_small", m, None) for i in range(50)
        for f, m in (("metricId", _MIN), ("unit", _MIN), ("recordedAt", "Number must be greater than or equal to 0"))]),
    16: (_document(*[_reading()] * 50), []),
}


def _checked_docs(spark, sf_dir) -> DataFrame:
    """Batch documents of all events, some of them replaced by faulty ones."""
    base = _batch_docs(spark, sf_dir)
    doc = F.col("doc")
    for n, (text, _) in _FAULTY.items():
        doc = F.when(F.col("event_id") % 100 == n, F.lit(text)).otherwise(doc)
    return base.select("event_id", doc.alias("doc"))


def _sql_text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


_FAULTY_SQL = ",\n".join(f"({n}, {i}, {', '.join(map(_sql_text, issue))})" for n, (_, expected) in _FAULTY.items() for i, issue in enumerate(expected))
_SOUND_SQL = f"event_id % 100 NOT IN ({', '.join(map(str, _FAULTY))})"

_ISSUES_SQL = _READINGS_SQL + f""",
docs AS (SELECT DISTINCT event_id, k % 47 = 0 AS no_batch, k % 31 = 0 AS no_device FROM telemetry WHERE {_SOUND_SQL}),
sound AS (SELECT * FROM rd WHERE {_SOUND_SQL}),
faulty AS (SELECT * FROM (VALUES {_FAULTY_SQL}) f(n, place, path, code, message, received)),
iss AS (
  SELECT event_id, 'telemetry.batchId' AS path, 'too_small' AS code, '{_MIN}' AS message, NULL::VARCHAR AS received, 0 AS ord FROM docs WHERE no_batch
  UNION ALL
  SELECT event_id, 'telemetry.devices[0].deviceId', 'too_small', '{_MIN}', NULL, 1 FROM docs WHERE no_device
  UNION ALL
  SELECT event_id, 'telemetry.devices[0].readings[' || CAST(reading_index AS VARCHAR) || '].' || u.field, u.code, u.message, u.received,
         10 + CAST(reading_index AS INTEGER) * 10 + u.place
  FROM sound, LATERAL (
    SELECT 'metricId' AS field, 'too_small' AS code, '{_MIN}' AS message, NULL::VARCHAR AS received, 0 AS place WHERE metric_id = ''
    UNION ALL SELECT 'value', 'not_finite', 'Number must be finite', NULL, 1 WHERE isinf(value) OR isnan(value)
    UNION ALL SELECT 'unit', 'too_small', '{_MIN}', NULL, 2 WHERE unit = ''
    UNION ALL SELECT 'recordedAt', 'invalid_type', 'Expected integer, received float', 'float', 3 WHERE recorded_at <> floor(recorded_at)
    UNION ALL SELECT 'recordedAt', 'too_small', 'Number must be greater than or equal to 0', NULL, 4 WHERE recorded_at < 0) u
  UNION ALL
  SELECT t.event_id, f.path, f.code, f.message, f.received, f.place FROM telemetry t JOIN faulty f ON t.event_id % 100 = f.n)"""


@register("batch_issues", with_views("telemetry", extra=_ISSUES_SQL) + "SELECT event_id, path, code, message, received FROM iss")
def batch_issues(spark, sf_dir):
    """One issue row per failed check with its full path and the type received."""
    return batches.issues(_checked_docs(spark, sf_dir)).select("event_id", "path", "code", "message", "received")


@register("issue_budget", with_views("telemetry", extra=_ISSUES_SQL + """,
run AS (SELECT *, 1 + SUM(strlen(path) + 2 + 1) OVER (PARTITION BY event_id ORDER BY ord
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bytes FROM iss)""") + """SELECT event_id, COUNT(*) AS error_count,
       CAST(to_json(COALESCE(list(path ORDER BY ord) FILTER (WHERE bytes <= 4096), [])) AS VARCHAR) AS paths_json,
       MAX(bytes) > 4096 AS truncated
FROM run GROUP BY event_id""")
def issue_budget(spark, sf_dir):
    """Paths kept from the front within a 4096-byte JSON budget per document."""
    return batches.issue_budget(batches.issues(_checked_docs(spark, sf_dir)))


# --------------------------------------------------------------------------- helpers over data


@register("refresh_clamp", with_views("telemetry", extra="""
w AS (SELECT device_id, user_id, MIN(time) AS mn, MAX(time) AS mx FROM telemetry GROUP BY device_id, user_id),
b AS (SELECT *, 20 + user_id % 12 AS retention_days, user_id % 25 AS margin_days,
             CASE WHEN (20 + user_id % 12) - (user_id % 25) <= 0 THEN NULL
                  ELSE TIMESTAMP '2024-01-31' - to_days(CAST((20 + user_id % 12) - (user_id % 25) AS INTEGER)) END AS boundary
      FROM w)""") + """SELECT device_id, boundary, CASE WHEN mn < boundary THEN boundary ELSE mn END AS start, mx AS "end",
       CASE WHEN mn < boundary THEN boundary ELSE mn END >= mx AS skipped
FROM b""")
def refresh_clamp(spark, sf_dir):
    """clamp each device's refresh window to the retention-safe region."""
    t = tables.telemetry(spark, sf_dir)
    w = t.groupBy("device_id", "user_id").agg(F.min("time").alias("mn"), F.max("time").alias("mx"))
    boundary, start, end, skipped = V.refresh_clamp(F.col("mn"), F.col("mx"), F.lit("2024-01-31").cast("timestamp_ntz"),
                                                    20 + F.col("user_id") % 12, F.col("user_id") % 25)
    return w.select("device_id", boundary.alias("boundary"), start.alias("start"), end.alias("end"), skipped.alias("skipped"))


@register("fee_estimate", with_views("billing_records", extra="""
tx AS (SELECT record_id,
              list_distinct([account_id, device_id, account_id] || CASE WHEN record_id % 2 = 0 THEN [cycle_id] ELSE [] END) AS rk,
              list_distinct(CASE WHEN record_id % 3 = 0 THEN [cycle_id, cycle_id] ELSE [cycle_id, account_id] END) AS wk
       FROM billing_records)""") + """SELECT record_id, CAST(len(rk) AS INTEGER) AS read_count, CAST(len(wk) AS INTEGER) AS write_count,
       CAST((len(rk) + len(wk)) * 100 + ceil((len(rk) + len(wk)) * 64 / 1024) * 100 AS BIGINT) AS fee,
       CAST(floor(((len(rk) + len(wk)) * 100 + ceil((len(rk) + len(wk)) * 64 / 1024) * 100) * 3) AS BIGINT) AS max_fee,
       CAST(floor(((len(rk) + len(wk)) * 100 + ceil((len(rk) + len(wk)) * 64 / 1024) * 100) * 1.2) AS BIGINT) AS recommended_fee
FROM tx""")
def fee_estimate(spark, sf_dir):
    """footprint de-duplication and fee estimate per transaction."""
    r = tables.billing_records(spark, sf_dir)
    rk = F.concat(F.array("account_id", "device_id", "account_id"),
                  F.when(F.col("record_id") % 2 == 0, F.array("cycle_id")).otherwise(F.array().cast("array<string>")))
    wk = F.when(F.col("record_id") % 3 == 0, F.array("cycle_id", "cycle_id")).otherwise(F.array("cycle_id", "account_id"))
    n_r, n_w, fee, mx, rec = V.fee_estimate(rk, wk)
    return r.select("record_id", n_r.alias("read_count"), n_w.alias("write_count"), fee.alias("fee"),
                    mx.alias("max_fee"), rec.alias("recommended_fee"))


@register("kv_to_map", f"""SELECT event_id, event_type AS type_value, CAST(value AS VARCHAR) AS value_text,
       CAST({K} AS VARCHAR) AS k_text, 3 AS map_size, false AS has_seq
FROM events""")
def kv_to_map(spark, sf_dir):
    """F16: flat ``[k, v, ...]`` stream replies to maps without ``seq``."""
    e = tables.read_table(spark, sf_dir, "events")
    flat = F.array(F.lit("seq"), F.col("event_id").cast("string"), F.lit("type"), F.col("event_type"),
                   F.lit("value"), F.col("value").cast("string"), F.lit("k"),
                   F.get_json_object("props", "$.k"))
    m = V.kv_list_to_map(flat)
    return e.select("event_id", m.getItem("type").alias("type_value"), m.getItem("value").alias("value_text"),
                    m.getItem("k").alias("k_text"), F.size(m).alias("map_size"),
                    F.map_contains_key(m, "seq").alias("has_seq"))

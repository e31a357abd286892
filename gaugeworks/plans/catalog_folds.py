"""Queries: ordered folds and binary/text sources.

Fold queries without an oracle are checked in ``tests/`` against plain
Python models; the driver records a rows-only check for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.timebuckets import epoch_ms, time_bucket
from ..operators import folds
from ..operators import validation as V
from ..sources import frames, payloads, tables, trace
from .catalog_validation import _HISTORY_SQL
from .oracle_views import with_views
from .registry import register

HOUR_MS = 3_600_000

# --------------------------------------------------------------------------- payloads


def _bodies(spark, sf_dir) -> DataFrame:
    """Signed bodies built from ``payloads``: envelopes, flat bodies and faults."""
    p = tables.payloads(spark, sf_dir)
    k = F.col("k")
    sig = F.when(k % 100 == 1, F.substring(F.sha2(F.col("nonce"), 512), 1, 126)).otherwise(F.sha2(F.col("nonce"), 512))
    pk = F.when(k % 100 == 3, F.substring(F.sha2(F.col("device_id"), 256), 1, 62)).otherwise(F.sha2(F.col("device_id"), 256))
    inner = F.struct(F.col("device_id").alias("deviceId"), F.col("ts_ms").alias("timestamp"),
                     F.when(k % 100 != 8, F.col("nonce")).alias("nonce"),
                     F.create_map(F.lit("energy_kwh"), (k / 10).cast("string")).alias("metrics"), sig.alias("signature"))
    envelope = F.to_json(F.struct(inner.alias("payload"),
                                  F.when(k % 100 != 2, pk).alias("publicKey")))
    flat = F.to_json(F.struct(inner["deviceId"].alias("deviceId"), inner["timestamp"].alias("timestamp"),
                              inner["nonce"].alias("nonce"), inner["metrics"].alias("metrics"),
                              inner["signature"].alias("signature"), F.when(k % 3 == 1, pk).alias("publicKey")))
    body = F.when(k % 3 == 0, envelope).otherwise(flat)
    # A numeric deviceId (wrong JSON type) where k % 100 == 7.
    body = F.when(k % 100 == 7, F.regexp_replace(body, r'"deviceId":"dev-(\d+)"', '"deviceId":$1')).otherwise(body)
    return p.select("event_id", "received_ms", body.alias("body"), (k % 100 != 4).alias("signature_ok"))


_PK_SQL = """CASE WHEN k % 100 = 3 THEN substr(sha256(device_id), 1, 62) ELSE sha256(device_id) END"""
_ENVELOPE_SQL = f"""env AS (
  SELECT event_id, k, received_ms, ts_ms, k % 100 IN (7, 8) AS malformed,
         CASE WHEN k % 100 = 7 THEN replace(device_id, 'dev-', '') ELSE device_id END AS device_id,
         CASE WHEN k % 100 = 8 THEN NULL ELSE nonce END AS nonce,
         CASE WHEN k % 100 = 1 THEN 126 ELSE 128 END AS signature_len,
         CASE WHEN k % 3 = 0 THEN CASE WHEN k % 100 = 2 THEN NULL ELSE {_PK_SQL} END
              WHEN k % 3 = 1 THEN {_PK_SQL} END AS public_key
  FROM payloads)"""


@register("payload_envelope", with_views("payloads", extra=_ENVELOPE_SQL) + """SELECT event_id, malformed, device_id, nonce, CAST(signature_len AS INTEGER) AS signature_len, ts_ms, public_key
FROM env""")
def payload_envelope(spark, sf_dir):
    """Parse envelope/flat bodies into typed payload columns."""
    parsed = payloads.parse_bodies(_bodies(spark, sf_dir))
    return parsed.select("event_id", "malformed", "device_id", "nonce", F.length("signature").alias("signature_len"),
                         "ts_ms", "public_key")


@register("payload_verdict", with_views("payloads", extra=_ENVELOPE_SQL + """,
pre AS (SELECT event_id, nonce, received_ms,
               CASE WHEN malformed THEN 'malformed_body'
                    WHEN public_key IS NULL THEN 'missing_public_key'
                    WHEN length(public_key) // 2 <> 32 THEN 'invalid_public_key_length'
                    WHEN signature_len // 2 <> 64 THEN 'Invalid signature length'
                    WHEN abs(received_ms - ts_ms) > 5000 THEN 'Timestamp outside sliding window'
                    WHEN k % 100 = 4 THEN 'Ed25519 signature mismatch' ELSE 'valid' END AS pre
        FROM env),
o AS (SELECT *, row_number() OVER (PARTITION BY COALESCE(nonce, '') ORDER BY received_ms, event_id) AS rn FROM pre),
r AS (SELECT COALESCE(nonce, '') AS nk, rn, event_id, pre,
             CASE WHEN pre = 'valid' THEN received_ms + 3600000 END AS expires, false AS replay
      FROM o WHERE rn = 1
      UNION ALL
      SELECT r.nk, o.rn, o.event_id, o.pre,
             CASE WHEN o.pre <> 'valid' THEN r.expires
                  WHEN r.expires IS NOT NULL AND r.expires > o.received_ms THEN r.expires
                  ELSE o.received_ms + 3600000 END,
             o.pre = 'valid' AND r.expires IS NOT NULL AND r.expires > o.received_ms
      FROM r JOIN o ON COALESCE(o.nonce, '') = r.nk AND o.rn = r.rn + 1)""", recursive=True) + """SELECT r.event_id, o.nonce,
       CASE WHEN r.pre <> 'valid' THEN r.pre WHEN r.replay THEN 'Nonce already consumed (replay detected)' ELSE 'valid' END AS verdict
FROM r JOIN o ON r.event_id = o.event_id""")
def payload_verdict(spark, sf_dir):
    """Ordered verdict; replay (one-hour window at driver scale) only among passing rows."""
    parsed = payloads.parse_bodies(_bodies(spark, sf_dir)).drop("body")
    v = payloads.payload_verdicts(parsed, replay_window_ms=HOUR_MS)
    return v.select("event_id", "nonce", "verdict")


@register("nonce_replay", with_views("payloads", extra="""
o AS (SELECT event_id, nonce, ts_ms, row_number() OVER (PARTITION BY nonce ORDER BY ts_ms, event_id) AS rn FROM payloads),
r AS (SELECT nonce, rn, event_id, ts_ms, ts_ms + 3600000 AS expires, false AS replay FROM o WHERE rn = 1
      UNION ALL
      SELECT o.nonce, o.rn, o.event_id, o.ts_ms,
             CASE WHEN r.expires > o.ts_ms THEN r.expires ELSE o.ts_ms + 3600000 END,
             r.expires > o.ts_ms
      FROM r JOIN o ON o.nonce = r.nonce AND o.rn = r.rn + 1)""", recursive=True) + """SELECT event_id, nonce, ts_ms, replay FROM r""")
def nonce_replay(spark, sf_dir):
    """Greedy replay guard per nonce (one-hour window at driver scale)."""
    p = tables.payloads(spark, sf_dir).select("event_id", "nonce", "ts_ms")
    return folds.replay_guard(p, "nonce", "ts_ms", ["ts_ms", "event_id"], window_ms=HOUR_MS)


@register("stream_dedup_batch", with_views("payloads") + """SELECT nonce, arg_min(event_id, (ts_ms, event_id)) AS first_event_id,
       MIN(ts_ms) AS first_ts_ms, COUNT(*) - 1 AS replays
FROM payloads GROUP BY nonce""")
def stream_dedup_batch(spark, sf_dir):
    """R4 batch twin without expiry: the first claim per nonce; later claims are replays."""
    p = tables.payloads(spark, sf_dir)
    return p.groupBy("nonce").agg(F.min_by("event_id", F.struct("ts_ms", "event_id")).alias("first_event_id"),
                                  F.min("ts_ms").alias("first_ts_ms"),
                                  (F.count(F.lit(1)) - 1).alias("replays"))


# --------------------------------------------------------------------------- reorder


def _frames(spark, sf_dir) -> DataFrame:
    """Per gateway frames numbered 1..n by event id, delivered in reversed runs of five.

    Frames whose ``k % 40 == 1`` come a second time, 37 runs later; gateways 0 to 2 lose those whose ``k % 50 == 0``,
    so everything behind the first loss waits, and more than 256 waiting frames are evicted.
    """
    t = tables.telemetry(spark, sf_dir).select(F.concat(F.lit("gw-"), (F.col("user_id") % 10).cast("string")).alias("device_id"), "event_id", "time", "k", "user_id")
    n = scan.row_number_in_order(t, "device_id", ["event_id"], chunk=time_bucket("1 day", "time"), out="frame_seq")
    sent = n.where(~((F.col("k") % 50 == 0) & (F.col("user_id") % 10 < 3)))
    arrival = F.floor((F.col("frame_seq") - 1) / 5) * 10 - F.col("frame_seq") % 5
    times = F.when(F.col("k") % 40 == 1, F.array(arrival, arrival + 375)).otherwise(F.array(arrival))
    return sent.select("device_id", "frame_seq", "event_id", F.explode(times).alias("arrival"))


_FRAMES_SQL = """
f AS (SELECT 'gw-' || CAST(user_id % 10 AS VARCHAR) AS device_id, user_id % 10 AS gateway, event_id, k,
             row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS frame_seq FROM telemetry),
fr AS (SELECT device_id, frame_seq, event_id, CAST(floor((frame_seq - 1) / 5) AS BIGINT) * 10 - frame_seq % 5 + again AS arrival
       FROM f, (VALUES (0), (375)) v(again) WHERE NOT (k % 50 = 0 AND gateway < 3) AND (again = 0 OR k % 40 = 1))"""


@register("reorder_deliver", with_views("telemetry", extra=_FRAMES_SQL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival) AS rn FROM fr),
r AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_seq, CAST(NULL AS BIGINT) AS event_id,
             CAST(NULL AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS delivered, CAST([] AS BIGINT[]) AS buf,
             CAST(0 AS BIGINT) AS drops, CAST(NULL AS VARCHAR) AS status, CAST([] AS BIGINT[]) AS released,
             CAST(NULL AS BIGINT) AS evicted
      FROM fr
      UNION ALL
      SELECT device_id, rn, frame_seq, event_id, arrival,
             CASE WHEN dup THEN delivered WHEN nxt THEN frame_seq + run ELSE delivered END,
             CASE WHEN dup THEN buf WHEN nxt THEN list_filter(buf, lambda x: x > frame_seq + run)
                  WHEN evict THEN list_filter(added, lambda x: x <> top) ELSE added END,
             drops + CASE WHEN NOT dup AND NOT nxt AND evict THEN 1 ELSE 0 END,
             CASE WHEN dup THEN 'duplicate' WHEN nxt THEN 'delivered' ELSE 'buffered' END,
             CASE WHEN nxt THEN range(frame_seq, frame_seq + run + 1) ELSE CAST([] AS BIGINT[]) END,
             CASE WHEN NOT dup AND NOT nxt AND evict THEN top END
      FROM (SELECT *, len(added) > 256 AS evict, list_max(added) AS top,
                   COALESCE(list_position(list_transform(later, lambda x, i: x = frame_seq + i), false) - 1, len(later)) AS run
            FROM (SELECT r.device_id, o.rn, o.frame_seq, o.event_id, o.arrival, r.delivered, r.buf, r.drops,
                         o.frame_seq <= r.delivered AS dup, o.frame_seq = r.delivered + 1 AS nxt,
                         list_distinct(list_append(r.buf, o.frame_seq)) AS added,
                         list_sort(list_filter(r.buf, lambda x: x > o.frame_seq)) AS later
                  FROM r JOIN o ON o.device_id = r.device_id AND o.rn = r.rn + 1)))""", recursive=True) + """SELECT device_id, frame_seq, event_id, arrival, status, released, evicted, delivered AS delivered_mark, drops
FROM r WHERE rn > 0""")
def reorder_deliver(spark, sf_dir):
    """Bounded reorder buffer (256) per device."""
    return folds.reorder_buffer(_frames(spark, sf_dir), window=folds.REORDER_WINDOW)


@register("reorder_prefix", with_views("telemetry", extra=_FRAMES_SQL + """,
kept AS (SELECT DISTINCT device_id, frame_seq FROM fr),
isl AS (SELECT device_id, frame_seq - row_number() OVER (PARTITION BY device_id ORDER BY frame_seq) AS island FROM kept),
run AS (SELECT device_id, COUNT(*) AS delivered FROM isl WHERE island = 0 GROUP BY device_id)""") + """SELECT d.device_id, CAST(COALESCE(run.delivered, 0) AS BIGINT) AS delivered
FROM (SELECT DISTINCT device_id FROM kept) d LEFT JOIN run ON d.device_id = run.device_id""")
def reorder_prefix(spark, sf_dir):
    """W8 with an unlimited buffer: delivered count = run of 1, 2, 3, ... per device."""
    return folds.reorder_prefix(_frames(spark, sf_dir))


# --------------------------------------------------------------------------- limiters and meters


@register("rate_limit", with_views("telemetry", extra="""
req AS (SELECT device_id, event_id, epoch_us(time) // 1000 AS t, CAST(k % 100 AS DOUBLE) / 100 AS c,
               [10, 100, 500][CAST(user_id % 3 AS INTEGER) + 1] AS tier FROM telemetry),
eager AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM req WHERE c > 0.95),
clock AS (SELECT device_id, n, t, event_id, t AS began, true AS starts FROM eager WHERE n = 1
          UNION ALL
          SELECT e.device_id, e.n, e.t, e.event_id, CASE WHEN e.t - c.began >= 216000000 THEN e.t ELSE c.began END, e.t - c.began >= 216000000
          FROM clock c JOIN eager e ON e.device_id = c.device_id AND e.n = c.n + 1),
sized AS (SELECT r.device_id, r.event_id, r.t, CASE WHEN count(s.t) > 0 THEN 3 ELSE 1 END AS boost, any_value(r.tier) AS tier, any_value(r.c) AS c
          FROM req r LEFT JOIN (SELECT * FROM clock WHERE starts) s
            ON s.device_id = r.device_id AND (s.t, s.event_id) <= (r.t, r.event_id) AND r.t - s.t < 18000000
          GROUP BY r.device_id, r.event_id, r.t),
ready AS (SELECT *, CAST(tier * boost AS DOUBLE) AS cap, CAST(tier AS DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * c) / 3600.0::DOUBLE * boost::DOUBLE AS rate,
                 row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM sized),
filled AS (SELECT device_id, n, event_id, t, cap, rate, cap AS before FROM ready WHERE n = 1
           UNION ALL
           SELECT r.device_id, r.n, r.event_id, r.t, r.cap, r.rate,
                  CASE WHEN r.t - f.t >= 12960000000 THEN r.cap
                       ELSE least(r.cap, f.before - CASE WHEN f.before >= 1 THEN 1 ELSE 0 END + CAST(r.t - f.t AS DOUBLE) / 1000.0::DOUBLE * r.rate) END
           FROM filled f JOIN ready r ON r.device_id = f.device_id AND r.n = f.n + 1),
spent AS (SELECT *, before - CASE WHEN before >= 1 THEN 1 ELSE 0 END AS after FROM filled)""", recursive=True) + """SELECT device_id, event_id, before >= 1 AS allowed,
       CAST(floor(after) AS BIGINT) AS tokens_remaining, CAST(cap AS BIGINT) AS max_tokens,
       t + CASE WHEN after < 1 THEN CAST(ceil((1 - after) / rate * 1000) AS BIGINT) ELSE 0 END AS reset_at_ms
FROM spent""")
def rate_limit(spark, sf_dir):
    """Token bucket per device; rates per hour at driver scale (``unit_s=3600``)."""
    t = tables.telemetry(spark, sf_dir)
    tiers = F.array(F.lit("free"), F.lit("standard"), F.lit("enterprise"))
    req = t.select("device_id", "event_id", epoch_ms("time").alias("time_ms"),
                   F.element_at(tiers, (F.col("user_id") % 3 + 1).cast("int")).alias("billing_tier"),
                   ((F.col("k") % 100) / 100.0).alias("compliance"))
    return folds.token_bucket(req, order=["time_ms", "event_id"], unit_s=3600.0).select(
        "device_id", "event_id", "allowed", "tokens_remaining", "max_tokens", "reset_at_ms")


@register("login_limit", with_views("telemetry", extra="""
o AS (SELECT 'ip-' || CAST(user_id % 20 AS VARCHAR) AS ip, event_id, epoch_us(time) // 1000 AS time_ms,
             row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_us(time) // 1000, event_id) AS rn FROM telemetry),
r AS (SELECT ip, rn, event_id, time_ms, CAST(1 AS BIGINT) AS attempts, time_ms + 3600000 AS reset_at,
             true AS allowed, CAST(0 AS BIGINT) AS delay_ms, CAST(NULL AS BIGINT) AS retry_after_s
      FROM o WHERE rn = 1
      UNION ALL
      SELECT o.ip, o.rn, o.event_id, o.time_ms,
             CASE WHEN (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) >= 5
                  THEN (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END)
                  ELSE (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) + 1 END,
             CASE WHEN r.reset_at < o.time_ms THEN o.time_ms + 3600000 ELSE r.reset_at END,
             (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) < 5,
             CASE WHEN (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) < 5
                       AND (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) + 1 > 3
                  THEN ((CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) + 1 - 3) * 100 ELSE 0 END,
             CASE WHEN (CASE WHEN r.reset_at < o.time_ms THEN 0 ELSE r.attempts END) >= 5
                  THEN CAST(ceil(((CASE WHEN r.reset_at < o.time_ms THEN o.time_ms + 3600000 ELSE r.reset_at END) - o.time_ms) / 1000) AS BIGINT) END
      FROM r JOIN o ON o.ip = r.ip AND o.rn = r.rn + 1)""", recursive=True) + """SELECT ip, event_id, time_ms, allowed, attempts, delay_ms, retry_after_s FROM r""")
def login_limit(spark, sf_dir):
    """Login attempts per IP, one-hour window at driver scale."""
    t = tables.telemetry(spark, sf_dir)
    req = t.select(F.concat(F.lit("ip-"), (F.col("user_id") % 20).cast("string")).alias("ip"), "event_id",
                   epoch_ms("time").alias("time_ms"))
    return folds.login_limiter(req, order=["time_ms", "event_id"], window_ms=HOUR_MS)


@register("storage_meter", with_views("telemetry", extra="""
o AS (SELECT device_id, event_id, epoch_us(time) // 1000000 AS t, CAST(k * 15 AS BIGINT) AS n, CASE WHEN k % 8 = 5 THEN CAST(k * 2500 AS BIGINT) END AS freed,
             row_number() OVER (PARTITION BY device_id ORDER BY epoch_us(time) // 1000000, event_id) AS rn FROM telemetry),
r AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS result,
             CAST(0 AS BIGINT) AS usage_bytes, CAST(0 AS BIGINT) AS metered_entries, CAST(NULL AS BIGINT) AS deadline
      FROM o
      UNION ALL
      SELECT device_id, rn, event_id, result,
             CASE WHEN result = 'ok' THEN usage_bytes + n * 512 WHEN result <> 'freed' THEN usage_bytes WHEN freed > usage_bytes THEN 0 ELSE usage_bytes - freed END,
             CASE WHEN result = 'ok' THEN metered_entries + n WHEN result <> 'freed' THEN metered_entries
                  WHEN freed > usage_bytes THEN 0 ELSE greatest(0, metered_entries - freed // 512) END,
             CASE WHEN result = 'ok' THEN t + 604800 WHEN result = 'freed' THEN deadline ELSE held END
      FROM (SELECT o.device_id, o.rn, o.event_id, o.t, o.n, o.freed, r.usage_bytes, r.metered_entries, r.deadline, coalesce(r.deadline, o.t + 604800) AS held,
                   CASE WHEN o.freed IS NOT NULL THEN 'freed' WHEN coalesce(r.deadline, o.t + 604800) <= o.t THEN 'ttl_expired'
                        WHEN o.n > 1000 THEN 'burst_exceeded' WHEN r.usage_bytes + o.n * 512 > 524288 THEN 'capacity_exceeded' ELSE 'ok' END AS result
            FROM r JOIN o ON o.device_id = r.device_id AND o.rn = r.rn + 1))""", recursive=True) + """SELECT device_id, event_id, result, usage_bytes, metered_entries
FROM r WHERE rn > 0""")
def storage_meter(spark, sf_dir):
    """Metered storage per device (TTL, burst and capacity checks); every eighth event or so frees bytes, which lifts the capacity check."""
    t = tables.telemetry(spark, sf_dir)
    b = t.select("device_id", "event_id", F.unix_seconds(F.col("time").cast("timestamp")).alias("time_s"),
                 (F.col("k") * 15).cast("bigint").alias("n_events"), F.when(F.col("k") % 8 == 5, (F.col("k") * 2500).cast("bigint")).alias("freed"))
    return folds.storage_meter(b, order=["time_s", "event_id"], freed="freed").select(
        "device_id", "event_id", "result", "usage_bytes", "metered_entries")


@register("state_replay", with_views("telemetry", "billing_records", extra=_HISTORY_SQL + """,
h AS (SELECT *, row_number() OVER (PARTITION BY machine, entity ORDER BY seq) AS rn FROM history),
r AS (SELECT machine, entity, CAST(0 AS BIGINT) AS rn,
             CASE machine WHEN 'ingestion' THEN 'PENDING' ELSE 'OPEN' END AS state, 0 AS applied
      FROM (SELECT DISTINCT machine, entity FROM history)
      UNION ALL
      SELECT r.machine, r.entity, r.rn + 1,
             CASE WHEN a.machine IS NOT NULL THEN h.to_state ELSE r.state END,
             r.applied + CASE WHEN a.machine IS NOT NULL THEN 1 ELSE 0 END
      FROM r JOIN h ON h.machine = r.machine AND h.entity = r.entity AND h.rn = r.rn + 1
      LEFT JOIN allowed a ON a.machine = h.machine AND a.from_state = r.state AND a.to_state = h.to_state)""",
    recursive=True) + """SELECT machine, entity, arg_max(state, rn) AS final_state, CAST(arg_max(applied, rn) AS BIGINT) AS applied,
       CAST(MAX(rn) - arg_max(applied, rn) AS BIGINT) AS refused
FROM r GROUP BY machine, entity""")
def state_replay(spark, sf_dir):
    """W6 replay: final state per entity when illegal requests are ignored
    (composition of transition maps, no per-row Python)."""
    from .catalog_validation import _history
    return V.replay_state_machine(_history(spark, sf_dir))


# --------------------------------------------------------------------------- billing cycles


def _cycle_requests(spark, sf_dir):
    """Finalize requests by record: some name no cycle, a third read their cycle before any request ran, some hold an older version."""
    r = tables.billing_records(spark, sf_dir)
    k = F.col("record_id")
    cycle = F.when(k % 17 == 0, F.concat(F.lit("missing:"), F.col("cycle_id"))).otherwise(F.col("cycle_id"))
    acct_no = F.regexp_replace("account_id", "acct-", "").cast("bigint")
    state = F.when(acct_no % 10 == 0, "SETTLED").otherwise("OPEN")
    early, older = (k % 17 != 0) & (k % 3 == 0), (k % 17 != 0) & (k % 11 == 0)
    req = r.select(k.alias("request_order"), cycle.alias("cycle_id"), F.concat(F.lit("key-"), (k % 5000).cast("string")).alias("idempotency_key"),
                   F.when(older, F.lit("OPEN")).when(early, state).alias("seen_state"),
                   F.when(older, F.lit(0)).when(early, F.lit(1)).cast("bigint").alias("seen_version"))
    cycles = r.select("cycle_id", state.alias("state")).distinct().withColumn("lock_version", F.lit(1))
    return req, cycles


@register("cycle_finalize", with_views("billing_records", extra="""
req AS (SELECT record_id AS request_order, CASE WHEN record_id % 17 = 0 THEN 'missing:' || cycle_id ELSE cycle_id END AS cycle_id,
               'key-' || CAST(record_id % 5000 AS VARCHAR) AS idempotency_key,
               CASE WHEN record_id % 17 = 0 THEN NULL WHEN record_id % 11 = 0 THEN 'older' WHEN record_id % 3 = 0 THEN 'early' END AS read FROM billing_records),
cyc AS (SELECT DISTINCT cycle_id, CASE WHEN CAST(replace(account_id, 'acct-', '') AS BIGINT) % 10 = 0 THEN 'SETTLED' ELSE 'OPEN' END AS state
        FROM billing_records),
r AS (SELECT req.*, cyc.state AS initial FROM req LEFT JOIN cyc ON req.cycle_id = cyc.cycle_id),
-- an older version never wins; all others that find the cycle OPEN do, and the first of them ends that
winners AS (SELECT cycle_id, MIN(request_order) AS first_at, arg_min(idempotency_key, request_order) AS key
            FROM r WHERE initial = 'OPEN' AND read IS DISTINCT FROM 'older' GROUP BY cycle_id),
claims AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_at) = 1 AS fresh FROM winners),
j AS (SELECT r.*, c.first_at, c.fresh, CASE WHEN c.first_at <= r.request_order THEN CASE WHEN c.fresh THEN 'FINALIZED' ELSE 'FINALIZING' END ELSE initial END AS now
      FROM r LEFT JOIN claims c ON r.cycle_id = c.cycle_id),
k AS (SELECT *, CASE WHEN initial IS NULL THEN 'not_found'
                     WHEN first_at = request_order THEN CASE WHEN fresh THEN 'finalized' ELSE 'duplicate_replay' END
                     WHEN read IS NULL THEN 'not_open'
                     WHEN read = 'early' AND initial <> 'OPEN' THEN 'not_open'
                     ELSE 'lost_race' END AS outcome FROM j)""") + """SELECT request_order, cycle_id, idempotency_key, outcome, outcome = 'finalized' AS finalized, now AS observed_state
FROM k""")
def cycle_finalize(spark, sf_dir):
    """Finalize requests with the versions they saw; one compare-and-set winner per version, first claim per key."""
    req, cycles = _cycle_requests(spark, sf_dir)
    return folds.finalize_cycles(req, cycles)


# --------------------------------------------------------------------------- admin actions

_ING = "['PENDING', 'TENTATIVE', 'SETTLED', 'ROLLED_BACK', 'RECONCILING', 'FAILED', 'GAP_DETECTED']"
_ACTIONS = "['onchain_rejection', 'force_settle', 'force_rollback', 'complete_reconciliation', 'fail_reconciliation']"


@register("admin_actions", with_views("telemetry", extra=f"""
rq AS (SELECT event_id AS request_id, device_id, {_ING}[user_id % 7 + 1] AS stored_state,
              {_ACTIONS}[k % 5 + 1] AS action FROM telemetry),
steps AS (SELECT * FROM (VALUES
  ('onchain_rejection', 'TENTATIVE', 1, 'TENTATIVE', 'ROLLED_BACK'), ('onchain_rejection', 'TENTATIVE', 2, 'ROLLED_BACK', 'RECONCILING'),
  ('force_rollback', 'TENTATIVE', 1, 'TENTATIVE', 'ROLLED_BACK'), ('force_rollback', 'TENTATIVE', 2, 'ROLLED_BACK', 'RECONCILING'),
  ('force_settle', 'TENTATIVE', 1, 'TENTATIVE', 'SETTLED'),
  ('complete_reconciliation', 'RECONCILING', 1, 'RECONCILING', 'PENDING'),
  ('fail_reconciliation', 'RECONCILING', 1, 'RECONCILING', 'FAILED')) s(action, required, step, from_state, to_state))""") + """SELECT rq.request_id, rq.device_id, rq.action, CAST(COALESCE(s.step, 0) AS INTEGER) AS step,
       COALESCE(s.from_state, rq.stored_state) AS from_state, s.to_state, s.step IS NOT NULL AS applied
FROM rq LEFT JOIN steps s ON rq.action = s.action AND rq.stored_state = s.required""")
def admin_actions(spark, sf_dir):
    """Admin and on-chain actions against the stored state; applied actions
    become one or two history rows, refused ones one row with ``applied = false``."""
    t = tables.telemetry(spark, sf_dir)
    states = F.array(*[F.lit(s) for s in V.INGESTION_STATES])
    acts = F.array(*[F.lit(a) for a in ("onchain_rejection", "force_settle", "force_rollback",
                                          "complete_reconciliation", "fail_reconciliation")])
    rq = t.select(F.col("event_id").alias("request_id"), "device_id",
                  F.element_at(states, (F.col("user_id") % 7 + 1).cast("int")).alias("stored_state"),
                  F.element_at(acts, (F.col("k") % 5 + 1).cast("int")).alias("action"))
    steps = V.config_table(spark, [
        ("onchain_rejection", "TENTATIVE", 1, "TENTATIVE", "ROLLED_BACK"),
        ("onchain_rejection", "TENTATIVE", 2, "ROLLED_BACK", "RECONCILING"),
        ("force_rollback", "TENTATIVE", 1, "TENTATIVE", "ROLLED_BACK"),
        ("force_rollback", "TENTATIVE", 2, "ROLLED_BACK", "RECONCILING"),
        ("force_settle", "TENTATIVE", 1, "TENTATIVE", "SETTLED"),
        ("complete_reconciliation", "RECONCILING", 1, "RECONCILING", "PENDING"),
        ("fail_reconciliation", "RECONCILING", 1, "RECONCILING", "FAILED"),
    ], "action string, required string, step int, from_state string, to_state string")
    j = rq.join(steps,
                (rq.action == steps.action) & (rq.stored_state == steps.required), "left")
    return j.select(rq.request_id, rq.device_id, rq.action, F.coalesce(steps.step, F.lit(0)).alias("step"),
                    F.coalesce(steps.from_state, rq.stored_state).alias("from_state"), steps.to_state,
                    steps.step.isNotNull().alias("applied"))


# --------------------------------------------------------------------------- trace, frames, proofs, fragments


def _trace_lines(spark, sf_dir) -> DataFrame:
    e = tables.read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ms = epoch_ms("ts").cast("string")
    text = (F.when(k % 13 == 0, F.lit(""))
             .when(k % 9 == 0, ms)
             .otherwise(F.concat(ms, F.lit(","), F.lit("dev-"), F.col("user_id").cast("string"))))
    data = e.select((F.col("event_id") + 1).alias("line_no"), text.alias("text"))
    header = spark.createDataFrame([(0, "timestampMs,deviceId")], "line_no long, text string")
    return header.unionByName(data).withColumn("line_chunk", F.floor(F.col("line_no") / 4096))


@register("trace_offsets", """WITH d AS (
  SELECT event_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS timestamp_ms,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 = 0 THEN NULL ELSE 'dev-' || CAST(user_id AS VARCHAR) END AS device_raw
  FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 13 <> 0),
n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM d)
SELECT row_index, timestamp_ms, COALESCE(device_raw, 'trace-device-' || CAST(row_index AS VARCHAR)) AS device_id,
       timestamp_ms - (SELECT MIN(timestamp_ms) FROM d) AS offset_ms
FROM n""")
def trace_offsets(spark, sf_dir):
    """Trace CSV lines (header, blanks, missing devices) to offsets."""
    return trace.parse_trace(_trace_lines(spark, sf_dir))


@register("frame_decode", with_views("telemetry", extra="""
fr AS (SELECT event_id, device_id, CAST(epoch_us(time) // 1000 AS DOUBLE) / 1000.0::DOUBLE AS ts, metric_id, metric_value,
              k % 4 AS m, k % 23 = 0 AS cut FROM telemetry),
eff AS (SELECT *, CASE WHEN cut AND m > 0 THEN m - 1 ELSE m END AS kept FROM fr)""") + """SELECT event_id AS frame_id, NULL::VARCHAR AS device_id, NULL::BIGINT AS sequence_number, NULL::DOUBLE AS "timestamp",
       NULL::INTEGER AS metric_index, NULL::INTEGER AS metric_id, NULL::DOUBLE AS value, false AS valid
FROM eff WHERE cut AND m = 0
UNION ALL
SELECT event_id, device_id, event_id, ts, NULL, NULL, NULL, true FROM eff WHERE NOT (cut AND m = 0) AND kept = 0
UNION ALL
SELECT event_id, device_id, event_id, ts, CAST(i AS INTEGER), CAST(metric_id * 10 + i AS INTEGER),
       CAST(metric_value AS DOUBLE) + i, true
FROM eff, range(kept) r(i) WHERE kept > 0""")
def frame_decode(spark, sf_dir):
    """Binary frames (built from readings, some truncated) decoded per metric."""
    t = tables.telemetry(spark, sf_dir)
    mids = F.expr("transform(array_repeat(0, cast(k % 4 as int)), (x, i) -> metric_id * 10 + i)")
    vals = F.expr("transform(array_repeat(0, cast(k % 4 as int)), (x, i) -> cast(metric_value as double) + i)")
    rd = t.select(F.col("event_id").alias("frame_id"), "device_id", F.col("event_id").alias("seq"),
                  (epoch_ms("time") / 1000.0).alias("ts"), mids.alias("metric_ids"), vals.alias("values"), "k")
    enc = frames.frames_from_readings(rd).join(rd.select("frame_id", "k"), "frame_id")
    cut = enc.select("frame_id", F.when(F.col("k") % 23 == 0, F.expr("substring(frame, 1, length(frame) - 5)"))
                     .otherwise(F.col("frame")).alias("frame"))
    return frames.decode_frames(cut)


@register("proof_audit", with_views("telemetry") + """SELECT event_id, device_id, CAST(k * 10 AS BIGINT) AS lower,
       CAST(CASE WHEN k % 11 = 0 THEN k * 10 ELSE k * 10 + 1000 END AS BIGINT) AS upper,
       -- The fixture forges every proof with k % 5 = 0 and gives k % 11 = 0 an empty range.
       k % 11 <> 0 AND k % 5 <> 0 AS verified
FROM telemetry""")
def proof_audit(spark, sf_dir):
    """Range-proof audit (every fifth proof forged, some with lower >= upper)."""
    t = tables.telemetry(spark, sf_dir)
    lower = (F.col("k") * 10).cast("bigint")
    upper = F.when(F.col("k") % 11 == 0, lower).otherwise(lower + 1000)
    commitment = F.unhex(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32))
    suffix = F.concat_ws(":", F.lit(""), F.col("device_id"), lower.cast("string"), upper.cast("string")).cast("binary")
    challenge = F.unhex(F.substring(F.sha2(F.concat(commitment, suffix), 512), 1, 32))
    forged = F.unhex(F.substring(F.sha2(F.concat(commitment, suffix), 256), 1, 32))
    response = F.unhex(F.sha2(F.col("device_id"), 256))
    proof = F.concat(commitment, F.when(F.col("k") % 5 == 0, forged).otherwise(challenge), response)
    p = t.select("event_id", "device_id", lower.alias("lower"), upper.alias("upper"), proof.alias("proof"))
    return p.select("event_id", "device_id", "lower", "upper",
                    V.range_proof_ok(F.col("proof"), F.col("device_id"), F.col("lower"), F.col("upper")).alias("verified"))


_FRAGMENTS_SQL = """WITH RECURSIVE shaped AS (
  SELECT *, conv_id % 4 = 2 AND turn >= 2 AS big FROM conversations),
c AS (
  SELECT 'conn-' || CAST(conv_id AS VARCHAR) AS connection_id, (turn + 1) * CASE WHEN conv_id % 4 = 1 THEN 40000 ELSE 10000 END AS now_ms,
         CASE WHEN big THEN strlen(text) * (1 + 40000 // strlen(text)) ELSE strlen(text) END + CASE WHEN turn % 3 = 2 OR big THEN 0 ELSE 1 END AS clen,
         turn % 3 <> 2 AND NOT big AS term, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM shaped),
r AS (SELECT DISTINCT connection_id, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS buf, CAST(NULL AS BIGINT) AS armed,
             false AS closed, false AS fired, CAST(0 AS BIGINT) AS fired_buf, false AS was_closed, false AS too_big,
             CAST(0 AS BIGINT) AS big_buf, CAST(NULL AS BIGINT) AS msg
      FROM c
      UNION ALL
      SELECT connection_id, pos,
             CASE WHEN closed0 OR too_big THEN 0 WHEN term THEN 0 ELSE buf1 + clen END,
             CASE WHEN closed0 OR too_big OR term THEN NULL WHEN buf1 + clen > 0 AND armed1 IS NULL THEN now_ms ELSE armed1 END,
             closed0 OR too_big, fired, fired_buf, closed0, too_big, buf1,
             CASE WHEN NOT closed0 AND NOT too_big AND term THEN buf1 + clen - 1 END
      FROM (SELECT *, NOT closed0 AND buf1 + clen > 65536 AS too_big FROM (
              SELECT r.connection_id, c.pos, c.now_ms, c.clen, c.term, r.closed AS closed0,
                     r.armed IS NOT NULL AND c.now_ms - r.armed >= 30000 AS fired, r.buf AS fired_buf,
                     CASE WHEN r.armed IS NOT NULL AND c.now_ms - r.armed >= 30000 THEN 0 ELSE r.buf END AS buf1,
                     CASE WHEN r.armed IS NOT NULL AND c.now_ms - r.armed >= 30000 THEN NULL ELSE r.armed END AS armed1
              FROM r JOIN c ON c.connection_id = r.connection_id AND c.pos = r.pos + 1)))
SELECT connection_id, pos AS event_pos, 'partial_message_timeout' AS kind, CAST(NULL AS INTEGER) AS payload_bytes,
       fired_buf AS buffer_bytes FROM r WHERE pos >= 0 AND fired
UNION ALL SELECT connection_id, pos, 'closed', NULL, 0 FROM r WHERE pos >= 0 AND was_closed
UNION ALL SELECT connection_id, pos, 'partial_message_too_large', NULL, big_buf FROM r WHERE pos >= 0 AND too_big
UNION ALL SELECT connection_id, pos, 'message', CAST(msg AS INTEGER), NULL FROM r WHERE pos >= 0 AND msg IS NOT NULL"""


def _chunks(conversations: DataFrame) -> DataFrame:
    """Conversation turns as chunks of one connection each: every third turn lacks its terminator.

    Turns are 10 s apart, on every fourth connection 40 s (over the 30 s that a partial message may wait); on
    another fourth all turns from the third on are 40 KB without an end, so the 64 KiB limit closes it.
    """
    big = (F.col("conv_id") % 4 == 2) & (F.col("turn") >= 2)
    raw = F.encode("text", "UTF-8")
    long = F.encode(F.expr("repeat(text, cast(1 + 40000 div octet_length(text) as int))"), "UTF-8")
    chunk = F.when(big, long).when(F.col("turn") % 3 == 2, raw).otherwise(F.concat(raw, F.unhex(F.lit("00"))))
    return conversations.select(F.concat(F.lit("conn-"), F.col("conv_id").cast("string")).alias("connection_id"),
                                ((F.col("turn") + 1) * F.when(F.col("conv_id") % 4 == 1, 40000).otherwise(10000)).alias("time_ms"), "turn", chunk.alias("chunk"))


@register("fragment_reassembly", _FRAGMENTS_SQL)
def fragment_reassembly(spark, sf_dir):
    """R9 batch twin: messages, timeouts, oversize partials and chunks after the closing."""
    out = folds.reassemble(_chunks(tables.read_table(spark, sf_dir, "conversations")).drop("turn"))
    return out.select("connection_id", "event_pos", "kind", F.length("payload").alias("payload_bytes"), "buffer_bytes")

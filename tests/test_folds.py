"""Ordered folds against plain Python models, on driver data and on the
small fixtures of the reference's unit tests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import folds
from gaugeworks.plans.registry import QUERIES, load_all

load_all()

from conftest import SF_SMALL

# --------------------------------------------------------------------------- plain models


def model_replay(claims, window):
    """claims: list of (key, t, id). Returns {id: replay}."""
    out, exp = {}, {}
    for key, t, i in sorted(claims, key=lambda c: (c[0], c[1], c[2])):
        if key in exp and exp[key] > t:
            out[i] = True
        else:
            exp[key] = t + window
            out[i] = False
    return out


def model_reorder(frames, window):
    """frames: list of (device, arrival, seq). Returns {(device, arrival): (status, released, evicted)}."""
    out = {}
    by_dev = {}
    for d, a, s in frames:
        by_dev.setdefault(d, []).append((a, s))
    for d, rows in by_dev.items():
        delivered, buf, drops = 0, set(), 0
        for a, s in sorted(rows):
            released, evicted = [], None
            if s <= delivered:
                status = "duplicate"
            elif s == delivered + 1:
                status = "delivered"
                delivered += 1
                released.append(s)
                while delivered + 1 in buf:
                    buf.remove(delivered + 1)
                    delivered += 1
                    released.append(delivered)
            else:
                status = "buffered"
                buf.add(s)
                if len(buf) > window:
                    evicted = max(buf)
                    buf.remove(evicted)
                    drops += 1
            out[(d, a)] = (status, released, evicted, delivered, drops)
    return out


def model_login(rows, window):
    out, state = {}, {}
    for ip, t, i in sorted(rows):
        att, reset = state.get(ip, (None, None))
        if att is None or reset < t:
            att, reset = 0, t + window
        if att >= 5:
            out[i] = (False, att)
        else:
            att += 1
            out[i] = (True, att)
        state[ip] = (att, reset)
    return out


def model_storage(rows):
    out, state = {}, {}
    for dev, t, i, n, freed in sorted(rows, key=lambda r: r[:3]):
        if freed is not None:
            if dev in state:
                state[dev] = (state[dev][0], max(0, state[dev][1] - freed))
            out[i] = ("freed", state[dev][1] if dev in state else 0)
            continue
        deadline, usage = state.get(dev, (t + 7 * 86400, 0))
        if not deadline > t:
            r = "ttl_expired"
        elif n > 1000:
            r = "burst_exceeded"
        elif usage + 512 * n > 524288:
            r = "capacity_exceeded"
        else:
            deadline, usage, r = t + 7 * 86400, usage + 512 * n, "ok"
        state[dev] = (deadline, usage)
        out[i] = (r, usage)
    return out


# --------------------------------------------------------------------------- tests


def test_replay_guard_boundaries(spark):
    """A 5000 ms window: accept 0, reject 4999, accept 5000, reject 9999, accept 10000."""
    df = spark.createDataFrame([("n", t, i) for i, t in enumerate([0, 4999, 5000, 9999, 10000])],
                               "nonce string, ts_ms long, id long")
    got = {r.id: r.replay for r in folds.replay_guard(df, "nonce", "ts_ms", ["ts_ms", "id"], 5000).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_replay_guard_matches_model_on_driver_data(spark):
    df = QUERIES["nonce_replay"](spark, SF_SMALL)
    got = {r.event_id: r.replay for r in df.collect()}
    rows = [(r.nonce, r.ts_ms, r.event_id) for r in df.select("nonce", "ts_ms", "event_id").collect()]
    assert got == model_replay(rows, 3_600_000)


def test_reorder_thousand_frames_in_shuffled_chunks(spark):
    """1..1000 shuffled in chunks of 50 with window 256: all delivered, no drops."""
    rnd = random.Random(7)
    seqs = []
    for c in range(20):
        chunk = list(range(c * 50 + 1, c * 50 + 51))
        rnd.shuffle(chunk)
        seqs += chunk
    df = spark.createDataFrame([("dev-1", i, s) for i, s in enumerate(seqs)], "device_id string, arrival long, frame_seq long")
    rows = folds.reorder_buffer(df, window=256).collect()
    released = [s for r in sorted(rows, key=lambda r: r.arrival) for s in r.released]
    assert released == list(range(1, 1001))
    assert max(r.drops for r in rows) == 0


def test_reorder_eviction_matches_model(spark):
    rnd = random.Random(3)
    frames = []
    for d in range(4):
        seqs = list(range(1, 80))
        rnd.shuffle(seqs)
        seqs += [rnd.randint(1, 80) for _ in range(10)]  # duplicates
        frames += [(f"dev-{d}", i, s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(frames, "device_id string, arrival long, frame_seq long")
    got = {(r.device_id, r.arrival): (r.status, list(r.released), r.evicted, r.delivered_mark, r.drops)
           for r in folds.reorder_buffer(df, window=8).collect()}
    assert got == model_reorder(frames, 8)


def test_reorder_on_driver_data_matches_model(spark):
    from gaugeworks.plans.catalog_folds import _frames
    fr = _frames(spark, SF_SMALL)
    frames = [(r.device_id, r.arrival, r.frame_seq) for r in fr.collect()]
    got = {(r.device_id, r.arrival): (r.status, list(r.released), r.evicted, r.delivered_mark, r.drops)
           for r in folds.reorder_buffer(fr, window=256).collect()}
    assert got == model_reorder(frames, 256)


def test_login_limiter_matches_model(spark):
    rows = [("ip-1", t, i) for i, t in enumerate([0, 10, 20, 30, 40, 50, 60, 70, 60_001, 60_100, 200_000])]
    df = spark.createDataFrame(rows, "ip string, time_ms long, id long")
    out = folds.login_limiter(df, order=["time_ms", "id"]).collect()
    got = {r.id: (r.allowed, r.attempts) for r in out}
    assert got == model_login(rows, 60_000)
    delays = {r.id: r.delay_ms for r in out}
    assert [delays[i] for i in range(5)] == [0, 0, 0, 100, 200]
    assert {r.id: r.retry_after_s for r in out}[5] == 60


def test_storage_meter_matches_model(spark):
    df = QUERIES["storage_meter"](spark, SF_SMALL)
    got = {r.event_id: (r.result, r.usage_bytes) for r in df.collect()}
    t = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "event_id", F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("d"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k")).collect()
    assert got == model_storage([(r.d, r.t, r.event_id, r.k * 15, r.k * 2500 if r.k % 8 == 5 else None) for r in t])


def test_token_bucket_basic_spend_and_refill(spark):
    """Standard tier, compliance 0.5: rate 75/s, bucket 100 starts full."""
    rows = [("d", 0, i, "standard", 0.5) for i in range(101)] + [("d", 1000, 101, "standard", 0.5)]
    df = spark.createDataFrame(rows, "device_id string, time_ms long, id long, billing_tier string, compliance double")
    out = sorted(folds.token_bucket(df, order=["time_ms", "id"]).collect(), key=lambda r: r.id)
    assert all(r.allowed for r in out[:100])
    assert not out[100].allowed
    assert out[100].reset_at_ms == 0 + -(-1000 // 75)  # ceil((1 - 0) / 75 * 1000)
    assert out[101].allowed and out[101].tokens_remaining == 74


def test_token_bucket_burst_when_compliant(spark):
    rows = [("d", 0, i, "free", 1.0) for i in range(31)]
    df = spark.createDataFrame(rows, "device_id string, time_ms long, id long, billing_tier string, compliance double")
    out = sorted(folds.token_bucket(df, order=["time_ms", "id"]).collect(), key=lambda r: r.id)
    assert out[0].max_tokens == 30
    assert sum(r.allowed for r in out) == 30


def test_state_replay_matches_model(spark):
    from gaugeworks.operators import validation as V
    from gaugeworks.plans.catalog_validation import _history
    h = _history(spark, SF_SMALL).collect()
    legal = {(m, a, b) for m, pairs in V.TRANSITIONS.items() for a, b in pairs}
    final = {}
    for r in sorted(h, key=lambda r: (r.machine, r.entity, r.seq)):
        cur = final.get((r.machine, r.entity), V.INITIAL_STATE[r.machine])
        final[(r.machine, r.entity)] = r.to_state if (r.machine, cur, r.to_state) in legal else cur
    got = {(r.machine, r.entity): r.final_state for r in QUERIES["state_replay"](spark, SF_SMALL).collect()}
    assert got == final


def test_reassembly_messages_timeouts_and_oversize(spark):
    rows = [("c", 0, b"ab"), ("c", 10, b"c\x00de"), ("c", 50_000, b"f\x00"), ("c", 50_001, b"x" * 70_000),
            ("c", 50_002, b"y\x00")]
    df = spark.createDataFrame(rows, "connection_id string, time_ms long, chunk binary")
    out = [(r.event_pos, r.kind, bytes(r.payload) if r.payload is not None else None)
           for r in sorted(folds.reassemble(df).collect(), key=lambda r: (r.event_pos, r.kind))]
    assert (1, "message", b"abc") in out
    assert (2, "partial_message_timeout", None) in out  # "de" waited 50 s
    assert (2, "message", b"f") in out
    assert (3, "partial_message_too_large", None) in out
    assert (4, "closed", None) in out


def test_frame_decode_roundtrip(spark):
    from gaugeworks.sources import frames
    f = frames.encode_frame("dev-1", 7, 1.5, [(1, 2.5), (2, -1.0)])
    assert frames.decode_frame(f) == ("dev-1", 7, 1.5, [(1, 2.5), (2, -1.0)])
    assert frames.decode_frame(f[:-5])[3] == [(1, 2.5)]
    assert frames.decode_frame(b"\x00") is None
    out = QUERIES["frame_decode"](spark, SF_SMALL)
    # Only frames cut inside their header (no metrics and 5 bytes removed) are invalid.
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(F.get_json_object("props", "$.k").cast("int").alias("k"))
    assert out.where(~F.col("valid")).count() == ev.where((F.col("k") % 23 == 0) & (F.col("k") % 4 == 0)).count()


def test_proof_audit_against_hashlib(spark):
    """P12 on random proofs built with hashlib, forged and real, then on driver data."""
    from gaugeworks.operators import validation as V
    rnd = random.Random(11)
    rows, expect = [], {}
    for i in range(60):
        commitment = bytes(rnd.getrandbits(8) for _ in range(16))
        dev, lo, hi = f"dev-{i}", rnd.randint(0, 100), rnd.randint(0, 200)
        real = hashlib.sha512(commitment + f":{dev}:{lo}:{hi}".encode()).digest()[:16]
        forged = i % 3 == 0
        challenge = bytes(16) if forged else real
        proof = commitment + challenge + bytes(rnd.getrandbits(8) for _ in range(32 if i % 7 else 31))
        rows.append((i, dev, lo, hi, proof))
        expect[i] = lo < hi and len(proof) == 64 and proof[16:32] == real
    df = spark.createDataFrame(rows, "id long, device_id string, lower long, upper long, proof binary")
    got = {r.id: r.ok for r in df.select("id", V.range_proof_ok(F.col("proof"), F.col("device_id"), F.col("lower"),
                                                                F.col("upper")).alias("ok")).collect()}
    assert got == expect and any(expect.values()) and not all(expect.values())
    out = {r.event_id: r.verified for r in QUERIES["proof_audit"](spark, SF_SMALL).collect()}
    ks = {r.event_id: r.k for r in spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).collect()}
    assert out == {e: (k % 11 != 0 and k % 5 != 0) for e, k in ks.items()}


def test_payload_verdict_order(spark):
    from gaugeworks.sources import payloads
    bodies = [
        (1, '{"deviceId": 5, "nonce": "a", "signature": "' + "ab" * 64 + '", "timestamp": 1000}', 1000, True),
        (2, '{"payload": {"deviceId": "d", "nonce": "b", "signature": "' + "ab" * 64 + '", "timestamp": 1000}}', 1000, True),
        (3, '{"payload": {"deviceId": "d", "nonce": "c", "signature": "' + "ab" * 64 + '", "timestamp": 1000}, "publicKey": "abcd"}', 1000, True),
        (4, '{"deviceId": "d", "nonce": "e", "signature": "abcd", "timestamp": 1000, "publicKey": "' + "cd" * 32 + '"}', 1000, True),
        (5, '{"deviceId": "d", "nonce": "f", "signature": "' + "ab" * 64 + '", "timestamp": 1000, "publicKey": "' + "cd" * 32 + '"}', 6001, True),
        (6, '{"deviceId": "d", "nonce": "g", "signature": "' + "ab" * 64 + '", "timestamp": 1000, "publicKey": "' + "cd" * 32 + '"}', 1000, False),
        (7, '{"deviceId": "d", "nonce": "h", "signature": "' + "ab" * 64 + '", "timestamp": 1000, "publicKey": "' + "cd" * 32 + '"}', 1000, True),
        (8, '{"deviceId": "d", "nonce": "h", "signature": "' + "ab" * 64 + '", "timestamp": 1000, "publicKey": "' + "cd" * 32 + '"}', 1001, True),
        (9, 'not json', 1000, True),
    ]
    df = spark.createDataFrame(bodies, "event_id long, body string, received_ms long, signature_ok boolean")
    v = {r.event_id: r.verdict for r in payloads.payload_verdicts(payloads.parse_bodies(df)).collect()}
    assert v == {1: "malformed_body", 2: "missing_public_key", 3: "invalid_public_key_length",
                 4: "Invalid signature length", 5: "Timestamp outside sliding window",
                 6: "Ed25519 signature mismatch", 7: "valid",
                 8: "Nonce already consumed (replay detected)", 9: "malformed_body"}


def test_state_replay_levels_with_small_fanout(spark):
    """Several levels of composition (chunks of 4 ids, fanout 4) give the same result as the model."""
    from gaugeworks.operators import validation as V
    rnd = random.Random(5)
    names = V.INGESTION_STATES
    rows = [("ingestion", f"e{rnd.randint(0, 3)}", i * 3 + rnd.randint(0, 2), rnd.choice(names)) for i in range(300)]
    df = spark.createDataFrame(rows, "machine string, entity string, seq long, to_state string")
    legal = {(m, a, b) for m, pairs in V.TRANSITIONS.items() for a, b in pairs}
    final, ok, no = {}, {}, {}
    for m, e, s, to in sorted(rows, key=lambda r: r[2]):
        cur = final.get(e, V.INITIAL_STATE[m])
        if (m, cur, to) in legal:
            final[e], ok[e] = to, ok.get(e, 0) + 1
        else:
            final[e], no[e] = cur, no.get(e, 0) + 1
    got = {r.entity: (r.final_state, r.applied, r.refused)
           for r in V.replay_state_machine(df, chunk_ids=4, fanout=4).collect()}
    assert got == {e: (final[e], ok.get(e, 0), no.get(e, 0)) for e in final}


def test_idle_session_split_matches_unsplit_on_a_hot_key(spark):
    """One hot nonce / IP / device: the session-split folds equal the plain folds."""
    rnd = random.Random(9)
    t, rows = 0, []
    for i in range(3000):
        t += rnd.choice([100, 900, 4000, 5000, 6000, 61_000, 3_700_000])
        rows.append(("hot", t, i))
    df = spark.createDataFrame(rows, "k string, t long, id long")
    split = folds.idle_sessions(df, "k", "t", 5000)
    assert split.select("_session").distinct().count() > 100
    a = {r.id: r.replay for r in folds.replay_guard(df, "k", "t", ["t", "id"], 5000).collect()}
    b = {r.id: r.replay for r in folds.replay_guard(df, "k", "t", ["t", "id"], 5000, split_idle=False).collect()}
    assert a == b == model_replay(rows, 5000)
    lg = df.withColumnRenamed("k", "ip").withColumnRenamed("t", "time_ms")
    a = {r.id: (r.allowed, r.attempts) for r in folds.login_limiter(lg, order=["time_ms", "id"]).collect()}
    b = {r.id: (r.allowed, r.attempts) for r in folds.login_limiter(lg, order=["time_ms", "id"], split_idle=False).collect()}
    assert a == b
    tb = lg.withColumnRenamed("ip", "device_id").withColumn("billing_tier", F.lit("free")).withColumn("compliance", F.lit(0.99))
    cols = ("allowed", "tokens_remaining", "max_tokens", "reset_at_ms")
    a = {r.id: tuple(r[c] for c in cols) for r in folds.token_bucket(tb, order=["time_ms", "id"]).collect()}
    b = {r.id: tuple(r[c] for c in cols) for r in folds.token_bucket(tb, order=["time_ms", "id"], split_idle=False).collect()}
    assert a == b


# --------------------------------------------------------------------------- hot keys


def _as_frames(rows):
    return {(r.device_id, r.arrival): (r.status, list(r.released), r.evicted, r.delivered_mark, r.drops) for r in rows}


@pytest.mark.parametrize("window", [4, 30, 256])
def test_reorder_of_a_hot_device_in_runs_equals_the_model(spark, window):
    """A device with most rows is cut where its buffer is empty; losses, duplicates, evictions and numbers below 1 among them."""
    rnd = random.Random(11)
    frames, seqs = [], []
    for c in range(60):
        block = list(range(c * 20 + 1, c * 20 + 21))
        rnd.shuffle(block)
        seqs += block + [rnd.randint(-2, c * 20 + 20) for _ in range(3)]
    frames += [("hot", i, s) for i, s in enumerate(seqs)]
    frames += [("late", i, s) for i, s in enumerate([2, 3, 4, 5, 6, 7, 8, 1, 9, 11, 12, 10, 10, 13])]
    lost = [s for s in range(1, 400) if s not in (150, 222)]
    frames += [("lost", i, s) for i, s in enumerate(lost + [150] + list(range(400, 420)))]
    df = spark.createDataFrame(frames, "device_id string, arrival long, frame_seq long")
    got = _as_frames(folds.reorder_buffer(df, window=window, run_rows=25).collect())
    assert got == model_reorder(frames, window)


def test_hot_device_is_many_runs(spark):
    from gaugeworks.functions import scan
    df = spark.createDataFrame([("hot", i, s) for i, s in enumerate(range(1, 1001))], "device_id string, arrival long, frame_seq long")
    runs = folds.reorder_runs(df, "device_id", "frame_seq", ["arrival"], 256, scan.even_chunks(F.col("arrival").cast("double"), 0, 999, 1000, 50))
    assert runs.select("_run").distinct().count() == 1000 and runs.where("_mark <> frame_seq - 1").count() == 0


@pytest.mark.parametrize("rows", [7, 40])
def test_storage_meter_in_rounds_with_deallocation_equals_the_model(spark, rows):
    rnd = random.Random(5)
    data = [(f"d{d}", 1000 * i, i, rnd.choice([3, 200, 600, 1001]), rnd.choice([None, None, None, 100, 400_000, 999_999])) for d in range(3)
            for i in range(120 if d == 0 else 9)]
    data += [("d1", 700_000_000 + i, 50 + i, 1, None) for i in range(3)]
    df = spark.createDataFrame(data, "device_id string, time_s long, event_id long, n_events long, freed long")
    out = folds.storage_meter(df, order=["time_s", "event_id"], freed="freed", rows=rows).collect()
    want = model_storage([(d, t, (d, i), n, f) for d, t, i, n, f in data])
    assert {(r.device_id, r.event_id): (r.result, r.usage_bytes) for r in out} == want
    assert {r.result for r in out} == {"ok", "freed", "ttl_expired", "burst_exceeded", "capacity_exceeded"}
    # freed storage lifts the capacity check
    order = [r.result for r in sorted(out, key=lambda r: r.time_s) if r.device_id == "d0"]
    assert "ok" in order[order.index("capacity_exceeded"):]


def test_reassembly_of_a_hot_connection_in_runs_equals_one_fold(spark):
    rnd = random.Random(9)
    rows = []
    for c, n in (("hot", 300), ("big", 60), ("few", 5)):
        t = 1_000_000
        for _ in range(n):
            t += rnd.choice([1, 5, 900, 29_999, 30_000, 45_000])
            body = rnd.choice([b"", b"ab", b"\x00", b"x\x00y", b"q" * 9000, b"end\x00", b"a\x00b\x00"])
            rows.append((c, t, body if c != "big" else body + b"z" * 20_000))
    df = spark.createDataFrame(rows, "connection_id string, time_ms long, chunk binary")
    cols = ["connection_id", "event_pos", "kind", "payload", "buffer_bytes"]

    def events(d):
        return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in d.select(*cols).collect()), key=str)

    got = events(folds.reassemble(df, run_rows=20))
    assert got == events(folds.reassemble(df))
    assert {r[2] for r in got} == {"message", "partial_message_timeout", "partial_message_too_large", "closed"}


def test_finalize_outcomes_by_versions(spark):
    req = spark.createDataFrame([
        (1, "a", "k1", None, None), (2, "a", "k2", "OPEN", 1), (3, "a", "k3", None, None), (4, "a", "k4", "FINALIZING", 2),
        (5, "b", "k5", "OPEN", 0), (6, "b", "k1", "OPEN", 1), (7, "b", "k6", "OPEN", 1), (8, "x", "k7", None, None),
        (9, "c", "k8", "SETTLED", 5), (10, "c", "k9", "OPEN", 5), (11, "d", "k1", "OPEN", 4), (12, "d", "k2", "OPEN", 4)],
        "request_order long, cycle_id string, idempotency_key string, seen_state string, seen_version long")
    cyc = spark.createDataFrame([("a", "OPEN", 1), ("b", "OPEN", 1), ("c", "SETTLED", 5), ("d", "OPEN", 4)], "cycle_id string, state string, lock_version int")
    out = folds.finalize_cycles(req, cyc)
    got = {r.request_order: (r.outcome, r.observed_state) for r in out.collect()}
    assert got == {1: ("finalized", "FINALIZED"), 2: ("lost_race", "FINALIZED"), 3: ("not_open", "FINALIZED"), 4: ("not_open", "FINALIZING"),
                   5: ("lost_race", "OPEN"), 6: ("duplicate_replay", "FINALIZING"), 7: ("lost_race", "FINALIZING"), 8: ("not_found", None),
                   9: ("not_open", "SETTLED"), 10: ("lost_race", "SETTLED"), 11: ("duplicate_replay", "FINALIZING"), 12: ("lost_race", "FINALIZING")}
    final = {r.cycle_id: (r.state, r.lock_version) for r in folds.final_cycle_states(out, cyc).collect()}
    assert final == {"a": ("FINALIZED", 3), "b": ("FINALIZING", 2), "c": ("SETTLED", 5), "d": ("FINALIZING", 5)}
    # without the read columns every request reads at its turn
    plain = {r.request_order: r.outcome for r in folds.finalize_cycles(req.drop("seen_state", "seen_version"), cyc).collect()}
    assert plain[2] == "not_open" and plain[5] == "finalized" and "lost_race" not in plain.values()

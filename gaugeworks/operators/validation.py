"""Ingest validation and audit checks.

Every check is a native column expression or a join against a table of
fixed size (metric ranges, transition tables), which is a property of the
configuration, not of the data. They are joined without hints: Spark broadcasts a
side whose size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Nonce window and freshness limits (milliseconds).
NONCE_WINDOW_MS = 5000
AGGREGATE_MAX_STALENESS_MS = 2 * 60 * 60 * 1000

# Metric name -> (lower bound, upper bound).
METRIC_RANGES = {
    "temperature": (-50, 150),
    "humidity": (0, 100),
    "voltage": (0, 500),
    "energy_kwh": (0, 1000000),
}

# Default billing tiers in insertion order; NULL max is unbounded.
DEFAULT_TIERS = [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 10000.0), ("TIER_3", 10001.0, None)]
UNKNOWN_TIER = "UNKNOWN_TIER"

# Legal transitions of the three state machines.
TRANSITIONS = {
    "ingestion": [
        ("PENDING", "TENTATIVE"), ("PENDING", "FAILED"), ("PENDING", "GAP_DETECTED"),
        ("TENTATIVE", "SETTLED"), ("TENTATIVE", "ROLLED_BACK"), ("TENTATIVE", "FAILED"),
        ("TENTATIVE", "GAP_DETECTED"),
        ("ROLLED_BACK", "RECONCILING"),
        ("RECONCILING", "PENDING"), ("RECONCILING", "FAILED"),
        ("GAP_DETECTED", "PENDING"), ("GAP_DETECTED", "FAILED"),
    ],
    "billing_cycle": [("OPEN", "FINALIZING"), ("FINALIZING", "FINALIZED"), ("FINALIZED", "SETTLED")],
    "batch": [("OPEN", "COMPACTING"), ("COMPACTING", "CLOSED")],
}
INITIAL_STATE = {"ingestion": "PENDING", "billing_cycle": "OPEN", "batch": "OPEN"}
INGESTION_STATES = ["PENDING", "TENTATIVE", "SETTLED", "ROLLED_BACK", "RECONCILING", "FAILED", "GAP_DETECTED"]

# Payload verdict reasons, in check order.
REASON_MALFORMED = "malformed_body"
REASON_MISSING_KEY = "missing_public_key"
REASON_KEY_LENGTH = "invalid_public_key_length"
REASON_SIGNATURE_LENGTH = "Invalid signature length"
REASON_STALE = "Timestamp outside sliding window"
REASON_SIGNATURE_MISMATCH = "Ed25519 signature mismatch"
REASON_REPLAY = "Nonce already consumed (replay detected)"
VALID = "valid"
PUBLIC_KEY_BYTES = 32
SIGNATURE_BYTES = 64

# Certificate verdict reasons (serial goes between the two parts).
CERT_OUTSIDE_WINDOW = "Certificate is outside validity window"
CERT_NOT_LISTED = "Serial %s not found in hardware whitelist"
CERT_REVOKED = "Certificate revoked in database"

# Submission errors.
BAD_SEQ_PATTERN = "(?i)tx_bad_seq"
BAD_SEQ_PREFIX = "ERR:"

# Tenant schema naming.
TENANT_PREFIX = "tenant_"
TENANT_MAX_CHARS = 48
TENANT_INVALID = "Invalid tenant id"

# Sampling rule.
SAMPLE_DOMAIN_ALWAYS = "blockchain"
SAMPLE_HIGH_PRIORITY = 2
SAMPLE_ALWAYS_OPERATION = "billing_finalize"
BASELINE_SAMPLE_RATIO = 0.1


def config_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --------------------------------------------------------------------------- payloads


def hex_decoded_length(col: Column) -> Column:
    """Byte length of a hex string decoded like Node's ``Buffer.from(s, 'hex')``:
    decoding stops at the first non-hex character and drops an odd last digit."""
    valid = F.regexp_extract(col, r"^[0-9a-fA-F]*", 0)
    return F.floor(F.length(valid) / 2).cast("int")


def is_fresh(ts_ms: Column, received_ms: Column, window_ms: int = NONCE_WINDOW_MS) -> Column:
    """P5: ``abs(received - ts) <= window`` (the boundary passes)."""
    return F.abs(received_ms - ts_ms) <= F.lit(window_ms)


def verdict(malformed: Column, public_key: Column, signature: Column, ts_ms: Column, received_ms: Column,
            signature_ok: Column, replay: Column | None = None, window_ms: int = NONCE_WINDOW_MS) -> Column:
    """First failing check wins; ``replay`` is evaluated only for rows that
    pass the rest (so a failing payload never claims its nonce)."""
    v = (F.when(malformed, F.lit(REASON_MALFORMED))
          .when(public_key.isNull(), F.lit(REASON_MISSING_KEY))
          .when(hex_decoded_length(public_key) != PUBLIC_KEY_BYTES, F.lit(REASON_KEY_LENGTH))
          .when(hex_decoded_length(signature) != SIGNATURE_BYTES, F.lit(REASON_SIGNATURE_LENGTH))
          .when(~is_fresh(ts_ms, received_ms, window_ms), F.lit(REASON_STALE))
          .when(~signature_ok, F.lit(REASON_SIGNATURE_MISMATCH)))
    if replay is not None:
        v = v.when(replay, F.lit(REASON_REPLAY))
    return v.otherwise(F.lit(VALID))


def metric_range_table(spark: SparkSession) -> DataFrame:
    return config_table(spark, [(k, lo, hi) for k, (lo, hi) in METRIC_RANGES.items()],
                        "metric_name string, lower_bound bigint, upper_bound bigint")


def out_of_range(readings: DataFrame, ranges: DataFrame, name: str = "metric_name",
                 value: str = "value") -> DataFrame:
    """P10: readings outside their metric's bounds (metrics without bounds are not checked)."""
    j = readings.join(ranges, name)
    return j.where((F.col(value) < F.col("lower_bound")) | (F.col(value) > F.col("upper_bound")))


def contract_event_valid(event_type: Column, timestamp: Column) -> Column:
    """``event_type < 1000 and timestamp > 0``."""
    return (event_type < 1000) & (timestamp > 0)


def range_proof_ok(proof: Column, device_id: Column, lower: Column, upper: Column) -> Column:
    """Bytes 16..32 of a 64-byte proof equal the first 16 bytes of
    SHA-512(commitment || ':device:lower:upper'); ``lower >= upper`` fails."""
    commitment = F.substring(proof, 1, 16)
    suffix = F.concat_ws(":", F.lit(""), device_id, lower.cast("string"), upper.cast("string")).cast("binary")
    digest = F.sha2(F.concat(commitment, suffix), 512)
    challenge_hex = F.lower(F.hex(F.substring(proof, 17, 16)))
    return (F.when(lower >= upper, F.lit(False))
             .when(F.length(proof) != 64, F.lit(False))
             .otherwise(F.substring(digest, 1, 32) == challenge_hex))


def tenant_schema_name(tenant_id: Column, on_invalid: str = "null") -> Column:
    """Strip ``[^a-zA-Z0-9_]``, keep 48 chars, prefix ``tenant_``; empty is invalid."""
    clean = F.substring(F.regexp_replace(tenant_id, r"[^a-zA-Z0-9_]", ""), 1, TENANT_MAX_CHARS)
    bad = F.length(clean) == 0
    invalid = (F.raise_error(F.lit(TENANT_INVALID)) if on_invalid == "raise"
               else F.lit(None).cast("string"))
    return F.when(bad, invalid).otherwise(F.concat(F.lit(TENANT_PREFIX), clean))


def scoped(df: DataFrame, tenant_id: str, col: str = "tenant_id") -> DataFrame:
    """Bind a read to one tenant (a partition filter when ``tenant_id`` partitions)."""
    return df.where(F.col(col) == tenant_id)


def cert_verdict(certs: DataFrame, whitelist: DataFrame, now: Column) -> DataFrame:
    """Outside validity window, not whitelisted, revoked, ok (first wins)."""
    j = certs.join(whitelist.select("serial", "revoked", F.lit(True).alias("_listed")), "serial", "left")
    reason = (F.when((F.col("valid_from") > now) | (F.col("valid_to") < now), F.lit(CERT_OUTSIDE_WINDOW))
               .when(F.col("_listed").isNull(),
                     F.format_string(CERT_NOT_LISTED, F.col("serial")))
               .when(F.col("revoked"), F.lit(CERT_REVOKED)))
    return j.select("serial", "device_id", reason.isNull().alias("verified"), reason.alias("reason"))


def tx_outcome(submissions: DataFrame, confirmations: DataFrame | None = None) -> DataFrame:
    """Outcome of a submission log ``(tx_id, attempt, error)``.

    An error matching ``tx_bad_seq`` (any case) on the first attempt is
    retried once; the final failure of a bad-sequence error is prefixed
    ``ERR:``; other errors fail as they are; no error is ``submitted``,
    upgraded to ``confirmed`` when a confirmation exists.
    """
    g = submissions.groupBy("tx_id").agg(
        F.max_by(F.struct("attempt", "error"), "attempt").alias("last"),
        F.count(F.lit(1)).alias("attempts"))
    last_err = F.col("last.error")
    status = F.when(last_err.isNull(), F.lit("submitted")).otherwise(F.lit("failed"))
    err = (F.when(last_err.isNull(), F.lit(None).cast("string"))
            .when(last_err.rlike(BAD_SEQ_PATTERN), F.concat(F.lit(BAD_SEQ_PREFIX), last_err))
            .otherwise(last_err))
    out = g.select("tx_id", "attempts", status.alias("status"), err.alias("error"))
    if confirmations is not None:
        c = confirmations.select("tx_id", F.lit(True).alias("_confirmed"))
        out = (out.join(c, "tx_id", "left")
                  .withColumn("status", F.when((F.col("status") == "submitted") & F.col("_confirmed"), F.lit("confirmed"))
                                         .otherwise(F.col("status")))
                  .drop("_confirmed"))
    return out


def retry_attempts(first_errors: DataFrame, retry_error: Column) -> DataFrame:
    """Build the submission log: attempt 1, plus attempt 2 only when attempt 1
    failed with a bad-sequence error."""
    a1 = first_errors.select("tx_id", F.lit(1).alias("attempt"), F.col("error"))
    a2 = (first_errors.where(F.col("error").rlike(BAD_SEQ_PATTERN))
                      .select("tx_id", F.lit(2).alias("attempt"), retry_error.alias("error")))
    return a1.unionByName(a2)


def freshness(last_refresh: Column, now: Column, max_staleness_ms: int = AGGREGATE_MAX_STALENESS_MS):
    """P20: ``(age_ms, fresh)`` with ``fresh = age <= max`` (inclusive)."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_refresh.cast("timestamp"))) / 1000
    age = F.floor(age).cast("bigint")
    return age, age <= F.lit(max_staleness_ms)


def hash_unit_interval(seed: Column) -> Column:
    """first 4 bytes of SHA-256(seed) as a big-endian uint32 / 2^32."""
    return F.conv(F.substring(F.sha2(seed.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def jittered_ttl(base: Column, jitter: Column, u: Column) -> Column:
    """``base + floor(u * (jitter + 1))``; ``base`` when jitter <= 0."""
    return F.when(jitter <= 0, base).otherwise(base + F.floor(u * (jitter + 1)).cast("bigint"))


def keep_span(domain: Column, priority: Column, operation: Column, trace_id: Column) -> Column:
    """Blockchain domain, priority 2 and billing finalize are always kept;
    the rest is kept when the trace's stable hash falls under 10 %."""
    rule = ((domain == SAMPLE_DOMAIN_ALWAYS) | (priority == SAMPLE_HIGH_PRIORITY)
            | (operation == SAMPLE_ALWAYS_OPERATION))
    return F.coalesce(rule, F.lit(False)) | (hash_unit_interval(trace_id) < F.lit(BASELINE_SAMPLE_RATIO))


# --------------------------------------------------------------------------- tiers


def tier_versions(spark: SparkSession, versions) -> DataFrame:
    """Tier config versions ``[(version_id, valid_from, [(tier, min, max), ...]), ...]``
    as one row per version with the tiers as an ordered array."""
    rows = [(v, vf, [(t, lo, hi) for t, lo, hi in tiers]) for v, vf, tiers in versions]
    return spark.createDataFrame(rows, "version_id string, valid_from timestamp_ntz, "
                                       "tiers array<struct<tier:string,min:double,max:double>>")


def pick_tier(value: Column, tiers: Column) -> Column:
    """First tier in insertion order with ``min <= value <= max`` (NULL max
    unbounded), else UNKNOWN_TIER."""
    hit = F.filter(tiers, lambda t: (value >= t["min"]) & (t["max"].isNull() | (value <= t["max"])))
    return F.coalesce(F.get(hit, 0)["tier"], F.lit(UNKNOWN_TIER))


def pick_listed_tier(value: Column, tiers) -> Column:
    """:func:`pick_tier` for a tier list known on the driver: a chain of conditions that compiles into the stage."""
    out = F.lit(UNKNOWN_TIER)
    for tier, low, high in reversed([tuple(t) for t in tiers]):
        inside = value >= F.lit(float(low))
        out = F.when(inside if high is None else inside & (value <= F.lit(float(high))), F.lit(tier)).otherwise(out)
    return out


def tiers_literal(tiers) -> Column:
    """A pinned tier list as a literal ``array<struct<tier,min,max>>`` column."""
    return F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(lo).cast("double").alias("min"),
                              F.lit(hi).cast("double").alias("max")) for t, lo, hi in tiers])


def assign_tier(readings: DataFrame, tiers=DEFAULT_TIERS, value: str = "value", version_id: str = "default") -> DataFrame:
    """J2/J3 (pinned): the whole job uses one config version, compiled into
    the plan as a literal, so tiering is a projection with no join."""
    return readings.select("*", F.lit(version_id).alias("version_id"),
                           pick_listed_tier(F.col(value), tiers).alias("tier"))


def _version_history(versions: DataFrame) -> Column:
    """All config versions as one sorted array: a scalar subquery, evaluated once a job."""
    rows = F.struct("valid_from", "version_id", "tiers")
    return versions.agg(F.array_sort(F.collect_list(rows)).alias("history")).scalar()


def _version_at(history: str, time: str) -> Column:
    """The latest version with ``valid_from <= time`` by binary search in the
    sorted array; before the first version the first one, none without versions."""
    mid = "(s.lo + s.hi + 1) div 2"
    place = (f"aggregate(sequence(0, cast(ceil(log2(size({history}) + 1)) as int)), struct(0L AS lo, cast(size({history}) as bigint) AS hi), "
             f"(s, i) -> IF(s.lo >= s.hi, s, IF(get({history}, cast({mid} - 1 as int)).valid_from <= `{time}`, "
             f"struct({mid} AS lo, s.hi AS hi), struct(s.lo AS lo, {mid} - 1 AS hi)))).lo")
    return F.expr(f"get({history}, cast(greatest({place}, 1L) - 1 as int))")


#: Longest version history that is compiled into the plan; a longer one is searched as an array.
LISTED_VERSIONS = 64


def assign_tier_asof(readings: DataFrame, versions: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """J3 history: each reading uses the latest version with ``valid_from <= time``.

    Readings before the first version fall back to the first (current default)
    version. There is no join and no shuffle of readings: a history of up to LISTED_VERSIONS
    versions becomes conditions of the plan, a longer one is one sorted array that each reading searches.
    """
    listed = versions.select("valid_from", "version_id", "tiers").limit(LISTED_VERSIONS + 1).collect()
    if 0 < len(listed) <= LISTED_VERSIONS:
        listed.sort(key=lambda r: (r["valid_from"], r["version_id"]))
        version, tier = F.lit(listed[0]["version_id"]), pick_listed_tier(F.col(value), listed[0]["tiers"])
        for r in listed[1:]:
            since = F.col(time) >= F.lit(r["valid_from"]).cast(dict(versions.dtypes)["valid_from"])
            version = F.when(since, F.lit(r["version_id"])).otherwise(version)
            tier = F.when(since, pick_listed_tier(F.col(value), r["tiers"])).otherwise(tier)
        return readings.withColumn("version_id", version).withColumn("tier", tier)
    found = readings.withColumn("_history", _version_history(versions)).withColumn("_version", _version_at("_history", time))
    return (found.withColumn("version_id", F.col("_version.version_id"))
                 .withColumn("tier", pick_tier(F.col(value), F.col("_version.tiers"))).drop("_history", "_version"))


def assign_tier_per_batch(readings: DataFrame, versions: DataFrame, batch: str = "batch_id", time: str = "time",
                          value: str = "value") -> DataFrame:
    """J3 (batch-consistent): every reading of a batch uses one config version.

    The version captured at the batch's first reading is compared with the
    one active at its last reading; when they differ the batch is redone
    under the newer one and counts as a config transition (A17
    ``config_transition_events``). Batch bounds are one aggregate row per
    batch; both versions are found in the sorted version array.
    """
    bounds = readings.groupBy(batch).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1")) \
        .withColumn("_history", _version_history(versions))
    per_batch = bounds.select(batch, _version_at("_history", "_t0")["version_id"].alias("start_version"), _version_at("_history", "_t1").alias("_last"))
    return (readings.join(per_batch, batch)
                    .withColumn("tier", pick_tier(F.col(value), F.col("_last.tiers")))
                    .withColumn("version_id", F.col("_last.version_id"))
                    .withColumn("transitioned", F.col("start_version") != F.col("version_id"))
                    .drop("_last"))


# --------------------------------------------------------------------------- state machines


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(m, a, b) for m, pairs in TRANSITIONS.items() for a, b in pairs]
    return config_table(spark, rows, "machine string, from_state string, to_state string")


def illegal_transitions(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests whose ``(machine, from, to)`` is not a legal transition."""
    return requests.join(allowed, ["machine", "from_state", "to_state"], "left_anti")


def audit_history(history: DataFrame, allowed: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Each step must be legal and start where the previous step ended
    (the first step starts at the machine's initial state)."""
    from ..functions import scan
    legal = allowed.select("machine", "from_state", "to_state", F.lit(True).alias("_legal"))
    d = scan.prev_in_order(history, ["machine", "entity"], "seq", "to_state", chunk=chunk, out="_prev_to")
    init = None
    for m, s in INITIAL_STATE.items():
        init = F.when(F.col("machine") == m, F.lit(s)) if init is None else init.when(F.col("machine") == m, F.lit(s))
    expected_from = F.coalesce(F.col("_prev_to"), init)
    return (d.join(legal, ["machine", "from_state", "to_state"], "left")
             .select("machine", "entity", "seq", "from_state", "to_state",
                     F.coalesce("_legal", F.lit(False)).alias("legal"),
                     (F.col("from_state") == expected_from).alias("consistent")))


# --------------------------------------------------------------------------- refresh windows and fees


def refresh_clamp(min_col: Column, max_col: Column, now: Column, retention_days: Column, margin_days: Column,
                  on_invalid: str = "null"):
    """``(boundary, start, end, skipped)``; boundary = now - (retention - margin) days."""
    safe = retention_days - margin_days
    boundary = now - F.make_dt_interval(days=safe.cast("int"))
    if on_invalid == "raise":
        boundary = F.when(safe <= 0, F.raise_error(F.lit("safety margin must be less than retention"))).otherwise(boundary)
    else:
        boundary = F.when(safe <= 0, F.lit(None)).otherwise(boundary)
    start = F.when(min_col < boundary, boundary).otherwise(min_col)
    skipped = start >= max_col
    return boundary, start, max_col, skipped


def fee_estimate(read_keys: Column, write_keys: Column):
    """de-duplicated footprint and fees.

    ``fee = (r + w) * 100 + ceil((r + w) * 64 / 1024) * 100``; max = floor(3x),
    recommended = floor(1.2x).
    """
    r = F.size(F.array_distinct(read_keys))
    w = F.size(F.array_distinct(write_keys))
    n = (r + w).cast("bigint")
    base = n * 100 + F.ceil(n * 64 / 1024).cast("bigint") * 100
    return r, w, base, F.floor(base * 3).cast("bigint"), F.floor(base * 1.2).cast("bigint")


def kv_list_to_map(flat: Column, drop_key: str = "seq") -> Column:
    """F16: ``[k1, v1, k2, v2, ...]`` -> map without ``drop_key``; of a repeated key the last value counts, a key without value gets the empty string."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(flat) - 1, F.lit(0)), F.lit(2)),
                        lambda i: F.struct(F.get(flat, i).alias("key"), F.coalesce(F.get(flat, i + 1), F.lit("")).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["key"] != drop_key))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


# --------------------------------------------------------------------------- W6 replay without Python


def _all_states() -> list[str]:
    seen: list[str] = []
    for pairs in TRANSITIONS.values():
        for a, b in pairs:
            for s in (a, b):
                if s not in seen:
                    seen.append(s)
    for s in INITIAL_STATE.values():
        if s not in seen:
            seen.append(s)
    return seen


def replay_state_machine(history: DataFrame, keys=("machine", "entity"), order: str = "seq",
                         chunk_ids: int = 100_000, fanout: int = 1000) -> DataFrame:
    """W6 replay as a parallel prefix over transition maps.

    A request ``to`` acts on the state set as ``f(s) = to if (s, to) is legal
    else s``; such maps compose associatively. Requests are grouped by
    ``order // chunk_ids`` (``order`` is unique, so a group holds at most
    ``chunk_ids`` requests) and folded with ``aggregate`` into one state map;
    groups of at most ``fanout`` maps are composed level by level until each
    entity has one map. Start states then flow back down: a child's start is
    its parent's start pushed through the composition of its earlier
    siblings. A last ``aggregate`` per bottom group counts applied and refused
    requests. All lists are bounded by ``fanout``, whatever the size of one
    entity's history; everything runs as JVM expressions.
    Returns ``(keys..., final_state, applied, refused)``.
    """
    keys = list(keys)
    states = _all_states()
    names = F.array(*[F.lit(s) for s in states])
    legal_keys = [f"{m}|{a}|{b}" for m, pairs in TRANSITIONS.items() for a, b in pairs]
    legal = F.create_map(*[x for k in legal_keys for x in (F.lit(k), F.lit(True))])
    init = F.create_map(*[x for m, s in INITIAL_STATE.items() for x in (F.lit(m), F.lit(states.index(s)))])
    machine = F.col(keys[0])
    identity = F.sequence(F.lit(0), F.lit(len(states) - 1))

    def is_legal(m, state_idx, to):
        key = F.concat(m, F.lit("|"), F.element_at(names, state_idx + 1), F.lit("|"), to)
        return F.coalesce(F.try_element_at(legal, key), F.lit(False))

    def to_idx(to):
        return (F.array_position(names, to) - 1).cast("int")

    def compose(first, then):
        return F.transform(first, lambda v: F.element_at(then, v + 1))

    top = (history.agg(F.max(order)).first()[0] or 0) // chunk_ids
    levels = 1
    while fanout ** levels <= top:
        levels += 1

    # Level 0: requests -> one map per (entity, order // chunk_ids).
    base = history.withColumn("_c0", F.floor(F.col(order) / chunk_ids))
    lvl0 = base.groupBy(*keys, "_c0").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("to_state").alias("to")))).alias("_reqs"))
    lvl0 = lvl0.withColumn("_f", F.aggregate(
        "_reqs", identity,
        lambda acc, x: F.transform(acc, lambda v: F.when(is_legal(machine, v, x["to"]), to_idx(x["to"])).otherwise(v))))
    # Upper levels: at most ``fanout`` child maps per parent, with exclusive prefixes.
    uppers = []
    child = lvl0.select(*keys, F.col("_c0").alias("_c"), "_f")
    for _ in range(1, levels + 1):
        grouped = (child.withColumn("_p", F.floor(F.col("_c") / fanout))
                        .groupBy(*keys, "_p")
                        .agg(F.sort_array(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_f").alias("f")))).alias("_kids")))
        walked = F.aggregate(
            "_kids", F.struct(identity.alias("m"), F.array().cast("array<struct<c:bigint,pre:array<int>>>").alias("pre")),
            lambda acc, k: F.struct(compose(acc["m"], k["f"]).alias("m"),
                                    F.concat(acc["pre"], F.array(F.struct(k["c"].cast("bigint").alias("c"),
                                                                          acc["m"].alias("pre")))).alias("pre")))
        grouped = grouped.withColumn("_w", walked)
        uppers.append(grouped.select(*keys, "_p", F.col("_w.pre").alias("_pre")))
        child = grouped.select(*keys, F.col("_p").alias("_c"), F.col("_w.m").alias("_f"))
    # ``child`` now has one map per entity; start states flow down the levels.
    starts = child.select(*keys, F.col("_c").alias("_p"), F.element_at(init, machine).alias("_s"))
    for up in reversed(uppers):
        kids = up.join(starts, [*keys, "_p"]).select(*keys, "_s", F.inline("_pre"))
        starts = kids.select(*keys, F.col("c").alias("_p"), F.element_at(F.col("pre"), F.col("_s") + 1).alias("_s"))
    j = lvl0.join(starts.withColumnRenamed("_p", "_c0"), [*keys, "_c0"])
    counted = F.aggregate("_reqs", F.struct(F.col("_s").alias("st"), F.lit(0).alias("ok"), F.lit(0).alias("no")),
                          lambda acc, x: F.when(is_legal(machine, acc["st"], x["to"]),
                                                F.struct(to_idx(x["to"]).alias("st"), (acc["ok"] + 1).alias("ok"),
                                                         acc["no"].alias("no")))
                          .otherwise(F.struct(acc["st"].alias("st"), acc["ok"].alias("ok"), (acc["no"] + 1).alias("no"))))
    c = j.select(*keys, "_c0", counted.alias("_r"))
    return (c.groupBy(*keys)
             .agg(F.max_by("_r.st", "_c0").alias("_st"), F.sum("_r.ok").cast("bigint").alias("applied"),
                  F.sum("_r.no").cast("bigint").alias("refused"))
             .select(*keys, F.element_at(names, F.col("_st") + 1).alias("final_state"), "applied", "refused"))

"""Boundary tables for scalar functions and small operators (values taken
from the reference's unit tests where it has them)."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import money
from gaugeworks.functions.timebuckets import time_bucket
from gaugeworks.operators import analytics, metrics
from gaugeworks.operators import validation as V
from gaugeworks.sources import trace


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,q", [(7, 3, 3), (10, 3, 4), (9, 3, 3), (0, 5, 0), (-7, 3, -3), (7, -3, -3),
                                   (-7, -3, 3), (100, 3, 34), (1, 7, 1)])
def test_round_up_div(spark, a, b, q):
    assert one(spark, money.round_up_div(F.lit(a), F.lit(b))) == q


def test_round_up_div_by_zero(spark):
    assert one(spark, money.round_up_div(F.lit(1), F.lit(0))) is None
    with pytest.raises(Exception):
        one(spark, money.round_up_div(F.lit(1), F.lit(0), on_zero="raise"))


def test_rescale_and_overflow(spark):
    assert one(spark, money.to_target_precision(F.lit(123456789), F.lit(9))) == 1234567
    assert one(spark, money.to_target_precision(F.lit(-123456789), F.lit(9))) == -1234567
    assert one(spark, money.to_target_precision(F.lit(5), F.lit(2))) == 500000
    assert one(spark, money.to_target_precision(F.lit(2 ** 62), F.lit(0))) is None
    assert one(spark, money.is_overflow(F.lit(2 ** 63 - 1))) is False
    assert one(spark, money.is_overflow(money.dec(F.lit(2 ** 63 - 1)) + 1)) is True
    assert one(spark, money.checked_add(F.lit(2 ** 63 - 1), F.lit(1))) is None
    assert one(spark, money.checked_multiply(F.lit(2 ** 32), F.lit(2 ** 31))) is None
    assert one(spark, money.checked_multiply(F.lit(2 ** 31), F.lit(2 ** 31))) == 2 ** 62
    # multiplyWithPrecision truncates toward zero
    assert one(spark, money.multiply_with_precision(F.lit(-7), F.lit(3), 1)) == -2
    # The product of two 64-bit extremes stays exact
    big = money.dec(F.lit(2 ** 63 - 1)) * money.dec(F.lit(2 ** 63 - 1))
    assert int(one(spark, big.cast("decimal(38,0)"))) == (2 ** 63 - 1) ** 2


@pytest.mark.parametrize("s,v", [("0.0001000", 1000), ("0.0002000", 2000), ("123.4567890", 1234567890),
                                 ("1", 10000000), ("1.123456789", 11234567), ("-1.5", -15000000), ("7.", 70000000)])
def test_stroops(spark, s, v):
    assert one(spark, money.decimal_string_to_units(F.lit(s))) == v


def test_price_units_watermark(spark):
    wm = (2 ** 63 - 1) * 80 // 100
    assert one(spark, money.price_units_flag(F.lit(wm), F.lit(1))) is False
    assert one(spark, money.price_units_flag(F.lit(wm + 1), F.lit(1))) is True


@pytest.mark.parametrize("start,end,res", [
    ("2026-01-01T00:00:00Z", "2026-01-01T05:00:00Z", "15m"),
    ("2026-01-01T00:00:00Z", "2026-01-01T06:00:00Z", "15m"),
    ("2026-01-01T00:00:00Z", "2026-01-03T00:00:00Z", "1h"),
    ("2026-01-01T00:00:00Z", "2026-01-20T00:00:00Z", "1d"),
    ("2026-01-01T00:00:00Z", "2026-04-22T00:00:00Z", "1w"),
    ("2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z", "1mo"),
    ("2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "15m"),
])
def test_pick_resolution(start, end, res):
    assert analytics.pick_resolution(start, end)[0] == res


def test_pick_resolution_rejects():
    with pytest.raises(analytics.BadRequest):
        analytics.pick_resolution("not-a-date", "2026-01-01")
    with pytest.raises(analytics.BadRequest):
        analytics.pick_resolution("2026-01-02", "2026-01-01")


def test_resolution_expr_matches_driver_side(spark):
    cases = [("2026-01-01 00:00:00", "2026-01-01 06:00:00"), ("2026-01-01 00:00:00", "2026-01-04 00:00:00"),
             ("2026-01-01 00:00:00", "2026-01-04 00:00:01"), ("2026-01-01 00:00:00", "2026-05-01 00:00:00"),
             ("2026-01-02 00:00:00", "2026-01-01 00:00:00")]
    df = spark.createDataFrame(cases, "s string, e string").select(
        F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    got = [r.v for r in df.select(analytics.resolution_expr(F.col("s"), F.col("e")).alias("v")).collect()]
    assert got == ["15m", "1h", "1d", "1w", None]


def test_time_buckets(spark):
    t = F.lit("2024-01-03 10:52:31").cast("timestamp_ntz")  # a Wednesday
    assert one(spark, time_bucket("15m", t)) == dt.datetime(2024, 1, 3, 10, 45)
    assert one(spark, time_bucket("1w", t)) == dt.datetime(2024, 1, 1)
    assert one(spark, time_bucket("1mo", t)) == dt.datetime(2024, 1, 1)
    assert one(spark, time_bucket("6 hours", t)) == dt.datetime(2024, 1, 3, 6)


def test_refresh_clamp(spark):
    now = F.lit("2026-03-25 00:00:00").cast("timestamp_ntz")
    b, s, e, skipped = V.refresh_clamp(F.lit("2026-03-20 00:00:00").cast("timestamp_ntz"),
                                       F.lit("2026-03-24 00:00:00").cast("timestamp_ntz"), now, F.lit(365), F.lit(5))
    r = spark.range(1).select(b.alias("b"), s.alias("s"), skipped.alias("k")).first()
    assert r.b == dt.datetime(2025, 3, 30) and r.s == dt.datetime(2026, 3, 20) and r.k is False
    b, s, e, skipped = V.refresh_clamp(F.lit("2025-03-26 00:00:00").cast("timestamp_ntz"),
                                       F.lit("2025-03-27 00:00:00").cast("timestamp_ntz"), now, F.lit(365), F.lit(5))
    assert spark.range(1).select(skipped.alias("k")).first().k is True
    b, s, e, skipped = V.refresh_clamp(F.lit("2026-01-01").cast("timestamp_ntz"), F.lit("2026-01-02").cast("timestamp_ntz"),
                                       now, F.lit(5), F.lit(5))
    assert spark.range(1).select(b.alias("b")).first().b is None


def test_freshness_inclusive(spark):
    age, fresh = V.freshness(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"),
                             F.lit("2026-01-01 02:00:00").cast("timestamp_ntz"))
    assert one(spark, fresh) is True
    age, fresh = V.freshness(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"),
                             F.lit("2026-01-01 02:00:00.001").cast("timestamp_ntz"))
    assert one(spark, fresh) is False


def test_hash_unit_interval_and_jitter(spark):
    for seed in ["a", "session-1:v0", "tok-42"]:
        u = int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) / 2 ** 32
        assert one(spark, V.hash_unit_interval(F.lit(seed))) == pytest.approx(u, abs=0)
    assert one(spark, V.jittered_ttl(F.lit(100), F.lit(0), F.lit(0.99))) == 100
    assert one(spark, V.jittered_ttl(F.lit(100), F.lit(10), F.lit(0.999))) == 110


def test_tenant_schema_name(spark):
    assert one(spark, V.tenant_schema_name(F.lit("acme-corp!"))) == "tenant_acmecorp"
    assert one(spark, V.tenant_schema_name(F.lit("x" * 60))) == "tenant_" + "x" * 48
    assert one(spark, V.tenant_schema_name(F.lit("!!"))) is None
    with pytest.raises(Exception):
        one(spark, V.tenant_schema_name(F.lit("!!"), on_invalid="raise"))


def test_hex_decoded_length(spark):
    assert one(spark, V.hex_decoded_length(F.lit("ab" * 64))) == 64
    assert one(spark, V.hex_decoded_length(F.lit("ab" * 64 + "c"))) == 64  # odd tail dropped
    assert one(spark, V.hex_decoded_length(F.lit("abzz"))) == 1


def test_pick_tier_defaults_and_gap(spark):
    tiers = V.tiers_literal(V.DEFAULT_TIERS)
    for v, t in [(0.0, "TIER_1"), (1000.0, "TIER_1"), (1000.5, "UNKNOWN_TIER"), (1001.0, "TIER_2"),
                 (10001.0, "TIER_3"), (1e12, "TIER_3"), (-1.0, "UNKNOWN_TIER")]:
        assert one(spark, V.pick_tier(F.lit(v), tiers)) == t


def test_fee_estimate(spark):
    r, w, fee, mx, rec = V.fee_estimate(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    row = spark.range(1).select(r.alias("r"), w.alias("w"), fee.alias("f"), mx.alias("m"), rec.alias("x")).first()
    assert (row.r, row.w, row.f, row.m, row.x) == (2, 1, 400, 1200, 480)


def test_kv_list_to_map(spark):
    m = V.kv_list_to_map(F.array(*[F.lit(x) for x in ["seq", "1", "a", "x", "b", "y"]]))
    assert one(spark, m) == {"a": "x", "b": "y"}


def test_exact_percentiles_index_rule(spark):
    """p50 of [1..10] is sorted[floor(0.5*10)] = 6 (not percentile_disc's 5)."""
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 11)], "g string, v double")
    r = metrics.exact_percentiles(df, "g", "v").first()
    assert (r.p50_ms, r.p90_ms, r.p95_ms, r.p99_ms) == (6.0, 10.0, 10.0, 10.0)
    r = metrics.exact_percentiles(df, "g", "v", chunk_width=3.0).first()
    assert (r.p50_ms, r.p90_ms) == (6.0, 10.0)


def test_baseline_compare(spark):
    cur = spark.createDataFrame([("r", 16.0, 100.0, 250.0, 481.0, 0.0)],
                                "run string, throughputPerSec double, accepted double, p95LatencyMs double, "
                                "p99LatencyMs double, errorRate double")
    got = {r.metric: (r.regression_pct, r.regressed) for r in metrics.compare_to_baseline(cur, "run").collect()}
    assert got["throughputPerSec"] == (pytest.approx(0.2), False)  # 20 % is allowed (strict >)
    assert got["p99LatencyMs"][1] is True
    assert got["errorRate"] == (pytest.approx(-1.0), False)
    base0 = dict(metrics.BASELINE, errorRate=0.0)
    got = {r.metric: r.regression_pct for r in metrics.compare_to_baseline(cur, "run", base0).collect()}
    assert got["errorRate"] == 0.0


def test_trace_parsing(spark):
    lines = ["timestampMs,deviceId", "1000,a", "", "970", "  1030 , b ", "1000"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")
    out = sorted(trace.parse_trace(df).collect(), key=lambda r: r.row_index)
    assert [(r.row_index, r.device_id, r.offset_ms) for r in out] == [
        (0, "a", 30.0), (1, "trace-device-1", 0.0), (2, "b", 60.0), (3, "trace-device-3", 30.0)]
    bad = spark.createDataFrame([(0, "1000,a"), (1, "oops,b")], "line_no long, text string")
    with pytest.raises(Exception):
        trace.parse_trace(bad).collect()


@pytest.mark.parametrize("listed", [64, 0])
def test_tier_asof_searches_the_versions(spark, monkeypatch, listed):
    """The latest version at or before the reading; the first one before that; none without versions. Compiled or searched."""
    monkeypatch.setattr(V, "LISTED_VERSIONS", listed)
    import datetime as dt
    readings = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 5), 1200.0), (2, dt.datetime(2024, 1, 12), 1200.0), (3, dt.datetime(2024, 1, 25), 1200.0),
         (4, dt.datetime(2023, 12, 1), 1200.0)],
        "id long, time timestamp_ntz, value double")
    tiers_wide = [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 50000.0), ("TIER_3", 10001.0, None)]
    tiers_narrow = [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 1100.0), ("TIER_3", 10001.0, None)]
    versions = V.tier_versions(spark, [("v1", dt.datetime(2024, 1, 1), tiers_wide),
                                       ("v2", dt.datetime(2024, 1, 10), tiers_narrow),
                                       ("v3", dt.datetime(2024, 1, 20), tiers_wide)])
    got = {r.id: (r.version_id, r.tier) for r in V.assign_tier_asof(readings, versions).collect()}
    many = V.tier_versions(spark, [(f"d{i}", dt.datetime(2023, 12, 20) + dt.timedelta(days=i), tiers_wide) for i in range(33)])
    assert {r.id: r.version_id for r in V.assign_tier_asof(readings, many).collect()} == {1: "d16", 2: "d23", 3: "d32", 4: "d0"}
    none = V.assign_tier_asof(readings, versions.where("false")).collect()
    assert {(r.version_id, r.tier) for r in none} == {(None, "UNKNOWN_TIER")}
    assert got == {1: ("v1", "TIER_2"), 2: ("v2", "UNKNOWN_TIER"), 3: ("v3", "TIER_2"), 4: ("v1", "TIER_2")}


def test_batch_pinned_tier_redoes_batch_after_version_change(spark):
    import datetime as dt
    tiers_wide = [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 50000.0), ("TIER_3", 10001.0, None)]
    tiers_narrow = [("TIER_1", 0.0, 1000.0), ("TIER_2", 1001.0, 1100.0), ("TIER_3", 10001.0, None)]
    versions = V.tier_versions(spark, [("v1", dt.datetime(2024, 1, 1), tiers_wide),
                                       ("v2", dt.datetime(2024, 1, 10), tiers_narrow)])
    readings = spark.createDataFrame(
        [(1, "b1", dt.datetime(2024, 1, 9, 23, 59), 1200.0), (2, "b1", dt.datetime(2024, 1, 10, 0, 1), 1200.0),
         (3, "b0", dt.datetime(2024, 1, 5), 1200.0)], "id long, batch_id string, time timestamp_ntz, value double")
    got = {r.id: (r.version_id, r.tier, r.transitioned) for r in V.assign_tier_per_batch(readings, versions).collect()}
    assert got == {1: ("v2", "UNKNOWN_TIER", True), 2: ("v2", "UNKNOWN_TIER", True), 3: ("v1", "TIER_2", False)}


def test_approx_percentiles_close_to_exact(spark):
    df = spark.range(0, 10_000).select(F.lit("g").alias("g"), (F.col("id") % 997).cast("double").alias("v"))
    exact = metrics.exact_percentiles(df, "g", "v", chunk_width=50.0).first()
    approx = metrics.approx_percentiles(df, "g", "v").first()
    for name in metrics.PERCENTILES:
        assert abs(exact[name] - approx[name]) <= 10


def test_trace_file_read_in_file_order(spark, tmp_path):
    lines = ["timestampMs,deviceId", "", "2000,a"] + [f"{1000 + i},d{i % 3}" for i in range(5000)] + ["1500"]
    p = tmp_path / "trace.csv"
    p.write_text("\n".join(lines) + "\n")
    out = sorted(trace.parse_trace(trace.read_lines(spark, str(p))).collect(), key=lambda r: r.row_index)
    assert len(out) == 5002
    assert (out[0].device_id, out[0].offset_ms) == ("a", 1000.0)
    assert (out[1].device_id, out[1].offset_ms) == ("d0", 0.0)
    assert out[-1].device_id == "trace-device-5001" and out[-1].offset_ms == 500.0


def test_kv_list_keeps_the_last_of_a_repeated_key(spark):
    rows = spark.createDataFrame([(1, ["a", "1", "seq", "9", "a", "2", "b"]), (2, []), (3, ["seq", "1"])], "id int, kv array<string>")
    got = {r.id: r.m for r in rows.select("id", V.kv_list_to_map(F.col("kv")).alias("m")).collect()}
    assert got == {1: {"a": "2", "b": ""}, 2: {}, 3: {}}


def test_trace_header_after_blank_lines_and_empty_first_field(spark):
    lines = spark.createDataFrame([(0, "  "), (1, "timestampMs,deviceId"), (2, ",d"), (3, "40,e")], "line_no long, text string")
    got = sorted((r.row_index, r.device_id, r.offset_ms) for r in trace.parse_trace(lines).collect())
    assert got == [(0, "d", 0.0), (1, "e", 40.0)]

"""Stored views with a live tail, maintenance by age, tenant-bound reads, bucketed links, entry-bounded ledger reads."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gaugeworks.operators import billing, rollups, stored_views
from gaugeworks.plans import catalog_billing, registry
from gaugeworks.sources import tables, telemetry_store
from gaugeworks.sources.stored import entries, finished
from gaugeworks.streaming import ledger_bus

from conftest import SF_SMALL

registry.load_all()


def _rows(df, cols=None):
    return sorted((tuple(r) for r in df.select(*(cols or sorted(df.columns))).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- stored views


@pytest.fixture(scope="module")
def readings(spark):
    return tables.telemetry(spark, SF_SMALL)


def _views_equal_rollups(spark, path, tel):
    for res, state in stored_views.live_views(spark, path, tel).items():
        got = rollups._finalize(state, ["bucket", "device_id"])
        assert _rows(got) == _rows(rollups.device_rollup(tel, res)), res


def test_live_views_equal_rollups_after_every_refresh(spark, readings):
    """Refreshed as of several times, the stored buckets and the tail give the whole rollup of what was read so far."""
    path = tempfile.mkdtemp(prefix="gw-live-") + "/views"
    for now in (dt.datetime(2024, 1, 9, 5, 20), dt.datetime(2024, 1, 9, 5, 50), dt.datetime(2024, 1, 30, 23, 0), dt.datetime(2024, 3, 2)):
        so_far = readings.where(F.col("time") <= F.lit(now).cast("timestamp_ntz"))
        stored_views.store_views(so_far, path, now)
        assert stored_views.refreshed_at(spark, path) == now
        _views_equal_rollups(spark, path, so_far)
        # later readings are in the tail at once
        _views_equal_rollups(spark, path, readings)
    months = stored_views.stored(spark, path).where("resolution = '1mo'")
    assert months.count() > 0 and months.where("bucket >= timestamp_ntz '2024-02-01'").count() == 0


def test_a_stored_view_read_prunes_partitions_and_readings(spark, readings):
    path = tempfile.mkdtemp(prefix="gw-live-") + "/views"
    now = dt.datetime(2024, 1, 20, 12, 0)
    stored_views.store_views(readings, path, now)
    p = plan(stored_views.live_views(spark, path, readings)["15m"])
    assert "resolution" in p[p.index("PartitionFilters"):].split("]")[0] and "day" in p[p.index("PartitionFilters"):].split("]")[0]
    scans = [s.split("ReadSchema")[0] for s in p.split("PushedFilters")[1:]]
    assert any("GreaterThanOrEqual(ts,2024-01-20T11:45" in s for s in scans), scans


# ---------------------------------------------------------------- maintenance


def _aged(spark, path, now, age="7 days"):
    return telemetry_store.compact_aged(spark, path, "telemetry", "day", now, age, [F.col("device_id"), F.col("region"), F.col("time").desc()]).first()


def test_aged_partitions_are_rewritten_once_and_keep_their_rows(spark, readings):
    path = tempfile.mkdtemp(prefix="gw-age-") + "/t"
    some = readings.select("time", "device_id", "metric_id", "metric_value", "region", "ingested_at")
    for n in range(3):  # fresh partitions are many small files
        telemetry_store.write_telemetry(some.where(F.pmod(F.xxhash64("time"), F.lit(3)) == n), path)
    cols = ["time", "device_id", "metric_id", "metric_value", "region", "day"]
    before = _rows(spark.read.parquet(path), cols)
    now = dt.datetime(2024, 1, 20)
    first, again = _aged(spark, path, now), _aged(spark, path, now)
    assert first.partitions == 12 and first.bytes_after < first.bytes_before
    assert first.compression_ratio_pct == pytest.approx((1 - first.bytes_after / first.bytes_before) * 100)
    assert again.partitions == 0 and again.compression_ratio_pct is None
    assert _aged(spark, path, now + dt.timedelta(days=2)).partitions == 2
    assert _rows(spark.read.parquet(path), cols) == before
    file = spark.read.parquet(f"{path}/day=2024-01-03").where("region_bucket = 0 or true")
    one = file.select("_metadata.file_path").first()[0]
    got = [(r.device_id, r.region, r.time) for r in spark.read.parquet(one).select("device_id", "region", "time").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1], -r[2].timestamp()))


def test_a_crash_while_partitions_are_replaced_loses_nothing(spark, readings, monkeypatch):
    from gaugeworks.sources import stored
    path = tempfile.mkdtemp(prefix="gw-age-") + "/t"
    telemetry_store.write_telemetry(readings.select("time", "device_id", "metric_id", "metric_value", "region", "ingested_at"), path)
    cols = ["time", "device_id", "metric_value", "day"]
    before = _rows(spark.read.parquet(path), cols)

    def dies(spark, journal, to):
        n = entries(spark, journal)[0]
        stored.remove(spark, f"{to}/{n}")  # the old partition is gone, the new one not yet there
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(stored, "replace_parts", dies)
        with pytest.raises(RuntimeError, match="crash"):
            _aged(spark, path, dt.datetime(2024, 1, 20))
    assert finished(spark, f"{path}-compacting") and _rows(spark.read.parquet(path), cols) != before
    _aged(spark, path, dt.datetime(2024, 1, 20))
    assert _rows(spark.read.parquet(path), cols) == before and not finished(spark, f"{path}-compacting")


# ---------------------------------------------------------------- tenants


def test_tenant_reads_name_one_tenant_and_scan_its_partition(spark, readings):
    path = tempfile.mkdtemp(prefix="gw-ten-") + "/t"
    telemetry_store.write_tenants(readings.select("tenant_id", "time", "device_id", "metric_value"), path)
    mine = telemetry_store.tenant_scan(spark, path, (F.col("tenant_schema") == "tenant_t3") & (F.col("device_id") != "dev-1"))
    assert {r[0] for r in mine.select("tenant_id").distinct().collect()} == {"t3"}
    assert "tenant_schema" in plan(mine)[plan(mine).index("PartitionFilters"):].split("]")[0]
    one = F.col("tenant_schema") == "tenant_t3"
    for loose in (F.col("device_id") == "dev-1", one | (F.col("device_id") == "dev-1"), F.col("tenant_schema").isin("tenant_t3", "tenant_t4"),
                  F.col("tenant_schema") > "tenant_t1", F.lit(True)):
        with pytest.raises(telemetry_store.TenantRequired):
            telemetry_store.tenant_scan(spark, path, loose)
    assert telemetry_store.schema_of("a-b/c!") == "tenant_abc"
    with pytest.raises(ValueError):
        telemetry_store.schema_of("#-# !")


# ---------------------------------------------------------------- links


def test_bucketed_cycle_join_does_not_shuffle_the_records(spark):
    """Nothing moves on the records' way to their cycles: no exchange stands between the bucketed scans and their join."""
    recs = spark.range(2000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), (F.col("id") % 90).cast("string"))).alias("cycle_id"))
    cycles = spark.range(80).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cycle_id"), F.lit("OPEN").alias("state"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        a, b = (billing.store_bucketed(t, "cycle_id", 8, n) for t, n in ((recs, "r"), (cycles, "c")))
        j = a.join(b.drop("cycle_id"), "_key", "left")
        assert "SortMergeJoin" in plan(j) and "Exchange" not in plan(j) and plan(j).count("Bucketed: true") == 2
        assert j.count() == 2000 and j.where("state is null").count() == recs.where("cycle_id is null or int(substr(cycle_id, 2)) >= 80").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_links_keep_orphans(spark):
    recs, logs = catalog_billing._links(spark, SF_SMALL)
    assert recs.count() == tables.billing_records(spark, SF_SMALL).count()
    n = recs.agg(F.count_if(F.expr("not device_known")), F.count_if(F.expr("cycle_id is null")), F.count_if(F.expr("cycle_id is not null and cycle_state is null")),
                 F.count_if(F.expr("cycle_account_id is not null and cycle_address is null")), F.count_if(F.expr("cycle_address = account_address"))).first()
    assert all(x > 0 for x in n), n
    assert logs.where("cycle_state is null").count() > 0 and logs.where("cycle_address is not null").count() > 0


# ---------------------------------------------------------------- ledger log


def _published(spark, n, segment, path):
    for lo in range(0, n, 100):
        part = spark.range(lo, min(lo + 100, n)).select((F.lit(n) - F.col("id")).alias("order"), F.create_map(F.lit("v"), F.col("id").cast("string")).alias("payload"))
        ledger_bus.publish(spark, path, part, segment)


def test_reads_are_bounded_by_entries_and_come_in_order(spark):
    path, ckpt = tempfile.mkdtemp(prefix="gw-bus-") + "/log", tempfile.mkdtemp(prefix="gw-ckpt-")
    _published(spark, 250, 20, path)
    assert [r[0] for r in spark.read.parquet(path).orderBy("seq").select("seq").collect()] == list(range(1, 251))
    reads = []
    ledger_bus.consume(spark, path, ckpt, lambda b, _: reads.append(sorted(r.seq for r in b.collect())), count=40, segment=20).awaitTermination()
    assert max(map(len, reads)) <= 40 and [s for r in reads for s in r] == list(range(1, 251))
    assert ledger_bus.pending_count(spark, ckpt) == 0


def test_a_failed_read_is_pending_until_the_consumer_resumes(spark):
    path, ckpt = tempfile.mkdtemp(prefix="gw-bus-") + "/log", tempfile.mkdtemp(prefix="gw-ckpt-")
    assert ledger_bus.pending_count(spark, ckpt) == 0
    _published(spark, 100, 10, path)
    seen = []

    def handler(batch, epoch_id):
        if epoch_id == 3 and len(seen) == 3:
            seen.append(None)
            raise RuntimeError("lost")
        seen.append(sorted(r.seq for r in batch.collect()))

    with pytest.raises(StreamingQueryException):
        ledger_bus.consume(spark, path, ckpt, handler, count=10, segment=10).awaitTermination()
    assert ledger_bus.pending_count(spark, ckpt) == 10
    ledger_bus.consume(spark, path, ckpt, handler, count=10, segment=10).awaitTermination()
    assert ledger_bus.pending_count(spark, ckpt) == 0
    assert [s for r in seen if r for s in r] == list(range(1, 101))

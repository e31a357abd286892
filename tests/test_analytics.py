"""Single-request reads against materialized rollups and the raw store."""

import tempfile

from pyspark.sql import functions as F

from gaugeworks.operators import analytics, rollups
from gaugeworks.sources import tables
from gaugeworks.sources.telemetry_store import read_telemetry, time_range, write_telemetry

from conftest import SF_SMALL


def test_analytics_range_reads_the_smallest_sufficient_rollup(spark):
    tel = tables.telemetry(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="gw-views-")
    views = {}
    for res, df in rollups.rollup_chain(tel).items():
        df.withColumn("day", F.to_date("bucket")).write.partitionBy("day").parquet(f"{base}/{res}")
        views[res] = spark.read.parquet(f"{base}/{res}")
    dev = tel.select("device_id").first().device_id
    for start, end, res in [("2024-01-05 10:07:00", "2024-01-05 15:07:00", "15m"),
                            ("2024-01-05 10:07:00", "2024-01-07 10:07:00", "1h"),
                            ("2024-01-02 00:00:00", "2024-01-21 00:00:00", "1d"),
                            ("2024-01-01 00:00:00", "2024-03-01 00:00:00", "1w")]:
        used, df = analytics.analytics_range(views, dev, start, end)
        assert used == res
        rows = df.collect()
        direct = (rollups.device_rollup(tel, res)
                  .where((F.col("device_id") == dev) & (F.col("bucket") >= F.lit(start).cast("timestamp_ntz"))
                         & (F.col("bucket") <= F.lit(end).cast("timestamp_ntz"))).orderBy("bucket").collect())
        assert [(r.bucket, r.sampleCount, r.totalValue) for r in rows] == \
               [(r.bucket, r.sample_count, r.total_value) for r in direct]
        assert [r.bucket for r in rows] == sorted(r.bucket for r in rows)
    # The device and bucket filters reach the scan of the chosen table.
    _, df = analytics.analytics_range(views, dev, "2024-01-05 10:07:00", "2024-01-07 10:07:00")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p and "device_id" in p[p.index("PushedFilters"):].split("]")[0]


def test_raw_range_half_open_and_ordered(spark):
    path = tempfile.mkdtemp(prefix="gw-raw-") + "/t"
    tel = tables.telemetry(spark, SF_SMALL).select("time", "device_id", "metric_id", "metric_value", "region",
                                                   "ingested_at")
    write_telemetry(tel, path)
    store = read_telemetry(spark, path)
    dev = tel.select("device_id").first().device_id
    t0 = tel.where(F.col("device_id") == dev).orderBy("time").select("time").collect()
    start, end = t0[1].time, t0[5].time
    got = analytics.raw_range(time_range(store, str(start), str(end)), dev, str(start), str(end)).collect()
    assert [r.time for r in got] == [r.time for r in t0[1:5]]


def test_event_page_keyset(spark):
    ev = spark.createDataFrame([("t1", i) for i in range(1, 251)] + [("t2", 1)], "tenant_id string, sequence long")
    page = analytics.event_page(ev, "t1", after_seq=100, limit=100).collect()
    assert [r.sequence for r in page] == list(range(101, 201))
    assert analytics.event_page(ev, "t1", after_seq=250).count() == 0
    p = analytics.event_page(ev, "t1", 0, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p


def test_generated_batches_are_contiguous(spark):
    import datetime as dt
    from gaugeworks.operators import sequence
    fl = spark.createDataFrame([("d1", dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 1, 0))],
                               "device_id string, first_start timestamp_ntz, last_start timestamp_ntz")
    b = sequence.generate_batches(fl)
    rows = sorted(b.collect(), key=lambda r: r.batch_start)
    assert len(rows) == 13 and rows[0].id == "d1:1704067200000"
    audit = {r.status for r in sequence.batch_contiguity(b.withColumn("state", F.lit("OPEN"))).collect()}
    assert audit == {"contiguous", "last"}


def test_materialize_all_views(spark):
    tel = tables.telemetry(spark, SF_SMALL)
    paths = rollups.materialize(tel, tempfile.mkdtemp(prefix="gw-mat-"))
    for res, path in paths.items():
        got = spark.read.parquet(path).drop("day")
        want = rollups.device_rollup(tel, res)
        assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == \
               sorted(tuple(r) for r in want.select(*sorted(want.columns)).collect()), res

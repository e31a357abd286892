"""Streams against their batch twins: several input files, micro-batches of
one file, and a restart from the checkpoint in the middle."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import folds, rollups
from gaugeworks.plans import catalog_streaming
from gaugeworks.sources import tables
from gaugeworks.sources.stored import read_epoch
from gaugeworks.streaming import rollups as srollups
from gaugeworks.streaming import sinks, stateful

from conftest import SF_SMALL


def _rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def event_files(spark):
    """The sf0.001 events split by day into separate files, written in day order."""
    src = tempfile.mkdtemp(prefix="gw-events-")
    ev = tables.read_table(spark, SF_SMALL, "events")
    days = sorted(r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())
    for i, d in enumerate(days):
        ev.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.parquet(f"{src}/part-{i:03d}")
    return src, ev.schema, len(days)


def _stream(spark, src, schema, max_files=1):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
                 .option("recursiveFileLookup", "true").parquet(src))


def test_windowed_rollup_equals_batch_with_restart(spark, event_files):
    src, schema, n_days = event_files
    out = tempfile.mkdtemp(prefix="gw-roll-") + "/t"
    ckpt = tempfile.mkdtemp(prefix="gw-ckpt-")
    tel = tables.telemetry_from(_stream(spark, src, schema))
    # First run: stop after a few micro-batches, then restart from the checkpoint.
    q = (srollups.windowed_rollup(tel, "1h").writeStream.outputMode("update")
         .foreachBatch(srollups.merge_rollup(out)).option("checkpointLocation", ckpt)
         .trigger(processingTime="0 seconds").start())
    while q.lastProgress is None or q.lastProgress["batchId"] < 3:
        q.awaitTermination(0.5)
    q.stop()
    q = srollups.run_rollup_stream(spark, tables.telemetry_from(_stream(spark, src, schema)), "1h", out,
                                   checkpoint=ckpt)
    q.awaitTermination()
    batch = rollups.device_rollup(tables.telemetry(spark, SF_SMALL), "1h")
    got = spark.read.parquet(out).drop("day")
    assert _rows(got) == _rows(batch)


def test_gap_monitor_stream_equals_batch(spark, event_files):
    from gaugeworks.operators import sequence
    src, schema, _ = event_files
    led = tables.ledger_from(_stream(spark, src, schema))
    out = tempfile.mkdtemp(prefix="gw-gaps-") + "/t"
    gaps = (stateful.stream_fold(led, "stream_id", ["arrival_ts", "arrival_id"], folds.gap_spec("sequence"))
            .where(F.col("expected_seq").isNotNull())
            .select("stream_id", "expected_seq", F.col("sequence").alias("observed_seq"), "missing_count"))
    q = (gaps.writeStream.foreachBatch(sinks.insert_ignore_sink(out, ["stream_id", "observed_seq"]))
             .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = sequence.sequence_gaps(tables.ledger(spark, SF_SMALL))
    assert _rows(spark.read.parquet(out)) == _rows(batch)


def test_reorder_stream_equals_batch(spark, event_files):
    src, schema, _ = event_files
    t = tables.telemetry_from(_stream(spark, src, schema)).select("device_id", "event_id")
    stream = stateful.stream_fold(t.withColumn("frame_seq", F.col("event_id") % 7 + 1), "device_id", ["event_id"],
                                  folds.reorder_spec("frame_seq", 3))
    out = tempfile.mkdtemp(prefix="gw-reorder-") + "/t"
    q = (stream.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    bt = tables.telemetry(spark, SF_SMALL).select("device_id", "event_id").withColumn("frame_seq", F.col("event_id") % 7 + 1)
    batch = folds.keyed_fold(bt, "device_id", ["event_id"], *folds.reorder_spec("frame_seq", 3))
    cols = ["device_id", "event_id", "status", "delivered_mark", "drops"]
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def test_exactly_once_sink_on_replayed_batch(spark):
    out = tempfile.mkdtemp(prefix="gw-sink-") + "/t"
    w = sinks.insert_ignore_sink(out, ["k"])
    b = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2")], "k long, v string")
    w(b, 0)
    w(b, 0)  # the same epoch replayed after a failure
    w(spark.createDataFrame([(3, "c"), (1, "z")], "k long, v string"), 1)
    got = sorted(r.k for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3]


def test_dedup_within_watermark_keeps_first(spark, event_files):
    src, schema, _ = event_files
    p = tables.payloads_from(_stream(spark, src, schema)).withColumn("time", F.timestamp_millis("ts_ms"))
    d = stateful.dedup_within_watermark(p, "nonce", "time", "1 hour")
    out = tempfile.mkdtemp(prefix="gw-dedup-") + "/t"
    q = (d.writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    kept = spark.read.parquet(out)
    assert kept.count() >= kept.select("nonce").distinct().count() > 0


def test_refresh_from_raw_rebuilds_touched_buckets(spark):
    import datetime as dt
    from gaugeworks.sources.telemetry_store import write_telemetry
    raw = tempfile.mkdtemp(prefix="gw-raw-") + "/t"
    roll = tempfile.mkdtemp(prefix="gw-r2-") + "/h"
    tel = tables.telemetry(spark, SF_SMALL).select("time", "device_id", "metric_id", "metric_value", "region",
                                                   "ingested_at")
    first = tel.where(F.col("time") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second = tel.where(F.col("time") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    now = dt.datetime(2024, 2, 1)
    for part in (first, second):
        write_telemetry(part, raw)
        srollups.refresh_from_raw(spark, raw, {"1h": roll}, part, now)
    got = spark.read.parquet(roll).drop("day")
    batch = rollups.device_rollup(tel, "1h")
    assert _rows(got) == _rows(batch)


def test_gap_resync_timer_fires_once(spark):
    import time as _time
    from gaugeworks.streaming.resync import resync_requests
    src = tempfile.mkdtemp(prefix="gw-r8-")
    schema = "entity string, to_state string, time_ms long"
    t0 = 1_700_000_000_000  # event times near epoch 0 read as "no watermark yet"
    spark.createDataFrame([("A", "GAP_DETECTED", t0), ("B", "GAP_DETECTED", t0), ("B", "PENDING", t0 + 30_000)],
                          schema).coalesce(1).write.parquet(f"{src}/f1")
    _time.sleep(1.1)
    spark.createDataFrame([("C", "TENTATIVE", t0 + 200_000)], schema).coalesce(1).write.parquet(f"{src}/f2")
    _time.sleep(1.1)
    # Timers fire in the batch after the one that moved the watermark.
    spark.createDataFrame([("D", "TENTATIVE", t0 + 300_000)], schema).coalesce(1).write.parquet(f"{src}/f3")
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(src).withColumn("t", F.timestamp_millis("time_ms")).withWatermark("t", "0 seconds"))
    out = tempfile.mkdtemp(prefix="gw-r8-out-") + "/t"
    q = (resync_requests(s).writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    req = [(r.entity, r.at_ms) for r in got.where(F.col("kind") == "resync_request").collect()]
    assert req == [("A", t0 + 60_000)]
    assert got.where(F.col("kind") == "transition").count() == 5


def test_token_bucket_stream_with_state_ttl_equals_batch(spark, event_files):
    """The stream keeps per-device bucket state with an event-time TTL."""
    src, schema, _ = event_files
    tiers = F.array(F.lit("free"), F.lit("standard"), F.lit("enterprise"))

    def requests(df):
        return df.select("device_id", "event_id", F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 1000)
                         .cast("bigint").alias("time_ms"),
                         F.element_at(tiers, (F.col("user_id") % 3 + 1).cast("int")).alias("billing_tier"),
                         ((F.col("k") % 100) / 100.0).alias("compliance"))

    spec = folds.token_bucket_spec(unit_s=3600.0)
    s = requests(tables.telemetry_from(_stream(spark, src, schema)))
    s = s.withColumn("et", F.timestamp_millis("time_ms")).withWatermark("et", "1 hour")
    stream = stateful.stream_fold(s, "device_id", ["time_ms", "event_id"], spec,
                                  timeout_ms=3600 * 3600 * 1000, event_time_ms="time_ms").drop("et")
    out = tempfile.mkdtemp(prefix="gw-r7-") + "/t"
    q = (stream.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = folds.keyed_fold(requests(tables.telemetry(spark, SF_SMALL)), "device_id", ["time_ms", "event_id"], *spec)
    cols = ["device_id", "event_id", "allowed", "tokens_remaining", "max_tokens", "reset_at_ms"]
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def test_sync_state_and_config_reload(spark):
    out = tempfile.mkdtemp(prefix="gw-s10-") + "/t"
    w = sinks.sync_state_sink(out)
    w(spark.createDataFrame([(5,), (9,)], "sequence long"), 0)
    w(spark.createDataFrame([(7,)], "sequence long"), 1)
    w(spark.createDataFrame([(7,)], "sequence long"), 1)  # a replay changes nothing
    r = sinks.sync_state(spark, out).first()
    assert (r.sync_id, r.last_synced, r.epoch_id) == ("ledger", 9, 1)
    seen = []
    cfg_path = tempfile.mkdtemp(prefix="gw-r12-") + "/cfg"
    spark.createDataFrame([("v1",)], "version_id string").write.parquet(cfg_path)
    apply = sinks.with_current_config(lambda s: s.read.parquet(cfg_path),
                                      lambda b, c, e: seen.append((e, c.first().version_id, b.count())))
    apply(spark.range(3), 0)
    spark.createDataFrame([("v2",)], "version_id string").write.mode("overwrite").parquet(cfg_path)
    apply(spark.range(2), 1)
    assert seen == [(0, "v1", 3), (1, "v2", 2)]


def test_fragment_reassembly_stream_equals_batch(spark):
    import time as _time
    src = tempfile.mkdtemp(prefix="gw-r9-")
    schema = "connection_id string, time_ms long, chunk binary"
    t0 = 1_700_000_000_000
    parts = [[("c1", t0, b"ab"), ("c2", t0, b"x\x00y")], [("c1", t0 + 10, b"c\x00de"), ("c2", t0 + 5, b"z\x00")],
             [("c1", t0 + 50_000, b"f\x00"), ("c2", t0 + 60_000, b"w" * 70_000)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f{i}")
        _time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out = tempfile.mkdtemp(prefix="gw-r9-out-") + "/t"
    q = (stateful.stream_reassemble(s).writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = folds.reassemble(spark.createDataFrame([r for p in parts for r in p], schema))
    cols = ["connection_id", "event_pos", "kind", "payload", "buffer_bytes"]
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def test_counter_flush_equals_batch(spark, event_files):
    src, schema, _ = event_files
    tel = tables.telemetry_from(_stream(spark, src, schema, max_files=5))
    out = tempfile.mkdtemp(prefix="gw-r10-") + "/t"
    q = (srollups.counter_flush(tel, ["tenant_id", "region"], watermark="1 hour").writeStream.outputMode("append")
         .format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    from gaugeworks.functions.timebuckets import time_bucket
    batch = (tables.telemetry(spark, SF_SMALL)
             .groupBy(time_bucket("1 minute", "time").alias("flush_minute"), "tenant_id", "region")
             .agg(F.count(F.lit(1)).alias("increments")))
    got = spark.read.parquet(out)
    # Append mode emits a minute once the watermark passes it; the newest hour may still be open.
    last = got.agg(F.max("flush_minute")).first()[0]
    assert _rows(got) == _rows(batch.where(F.col("flush_minute") <= F.lit(last)))
    assert got.count() > 0.9 * batch.count()


def test_ingest_with_refresh_every_n(spark, event_files):
    src, schema, n_days = event_files
    base = tempfile.mkdtemp(prefix="gw-r3-")
    tel = tables.telemetry_from(_stream(spark, src, schema, max_files=3)).select(
        "time", "device_id", "metric_id", "metric_value", "region", "ingested_at")
    import datetime as dt
    w = srollups.ingest_with_refresh(f"{base}/raw", {"1h": f"{base}/h"}, f"{base}/counter", every=1,
                                     now=dt.datetime(2024, 2, 1))
    q = tel.writeStream.foreachBatch(w).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/h").drop("day")
    batch = rollups.device_rollup(tables.telemetry(spark, SF_SMALL), "1h")
    assert _rows(got) == _rows(batch)
    c = read_epoch(spark, f"{base}/counter").first()
    assert c.total == tables.telemetry(spark, SF_SMALL).count() and c.refreshed
    # Replaying the last epoch changes nothing.
    w(spark.read.parquet(f"{base}/raw").limit(3).drop("epoch", "day", "region_bucket"), c.epoch_id)
    assert read_epoch(spark, f"{base}/counter").first().total == c.total


def test_ledger_bus_publish_consume_restart_trim(spark):
    from gaugeworks.streaming import ledger_bus
    base = tempfile.mkdtemp(prefix="gw-s11-")
    log, sink = f"{base}/log", f"{base}/sink"
    for i in range(3):
        payloads = spark.range(i * 10, i * 10 + 10).select(
            F.col("id").alias("order"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("payload"))
        ledger_bus.publish(spark, log, payloads)
    seqs = sorted(r.seq for r in spark.read.parquet(log).collect())
    assert seqs == list(range(1, 31))
    handler = sinks.insert_ignore_sink(sink, ["seq"])
    q = ledger_bus.consume(spark, log, f"{base}/ckpt", handler, count=1)
    q.awaitTermination()
    # A restart resumes from the checkpoint and a new publish is delivered once.
    ledger_bus.publish(spark, log, spark.range(100, 105).select(
        F.col("id").alias("order"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("payload")))
    q = ledger_bus.consume(spark, log, f"{base}/ckpt", handler, count=1)
    q.awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(sink).collect())
    assert got == list(range(1, 36))
    assert not ledger_bus.trim(spark, log, max_len=10, consumed=0)  # nothing unread goes
    removed = ledger_bus.trim(spark, log, max_len=10, consumed=35)
    assert removed
    left = spark.read.parquet(log)
    assert left.agg(F.max("seq")).first()[0] == 35 and left.agg(F.min("seq")).first()[0] > 1


def test_exactly_once_sink_reads_only_touched_partitions(spark):
    out = tempfile.mkdtemp(prefix="gw-sinkp-") + "/t"
    w = sinks.insert_ignore_sink(out, ["day", "k"], partition_by=["day"])
    w(spark.createDataFrame([("2024-01-01", 1, "a"), ("2024-01-02", 1, "b")], "day string, k long, v string"), 0)
    w(spark.createDataFrame([("2024-01-01", 1, "dup"), ("2024-01-03", 1, "c")], "day string, k long, v string"), 1)
    got = sorted((r.day, r.k, r.v) for r in spark.read.parquet(out).collect())
    assert [(str(d), k, v) for d, k, v in got] == [("2024-01-01", 1, "a"), ("2024-01-02", 1, "b"), ("2024-01-03", 1, "c")]


def test_exact_replay_guard_stream_equals_batch(spark, event_files):
    """R4 exact: per-nonce state in the state store, expired by event time."""
    src, schema, _ = event_files
    window = 3_600_000
    p = tables.payloads_from(_stream(spark, src, schema)).select("nonce", "event_id", "ts_ms")
    p = p.withColumn("et", F.timestamp_millis("ts_ms")).withWatermark("et", "1 hour")
    stream = stateful.stream_fold(p, "nonce", ["ts_ms", "event_id"], folds.replay_spec("ts_ms", window),
                                  timeout_ms=window, event_time_ms="ts_ms").drop("et")
    out = tempfile.mkdtemp(prefix="gw-r4-") + "/t"
    q = (stream.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = folds.replay_guard(tables.payloads(spark, SF_SMALL).select("nonce", "event_id", "ts_ms"), "nonce", "ts_ms",
                               ["ts_ms", "event_id"], window_ms=window)
    cols = ["nonce", "event_id", "replay"]
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def test_writers_raise_on_a_damaged_target(spark):
    """A read error is not an empty table: nothing is written and what is stored stays."""
    import os

    import pytest
    from gaugeworks.streaming import ledger_bus
    base = tempfile.mkdtemp(prefix="gw-damage-")
    keyed = spark.createDataFrame([(1, "a")], "k int, v string")
    hourly = spark.createDataFrame([(1, "dev-1", 2.0)], "h int, device_id string, total double").select(
        F.to_timestamp_ntz(F.lit("2024-01-01 05:00:00")).alias("bucket"), "device_id", "total")
    log = spark.range(2).select(F.col("id").alias("order"), F.create_map(F.lit("n"), F.lit("1")).alias("payload"))
    cases = {"keys": lambda p: sinks.insert_ignore_sink(p, ["k"])(keyed, 0), "hours": lambda p: srollups.merge_rollup(p)(hourly, 0),
             "log": lambda p: ledger_bus.publish(spark, p, log)}
    for name, write in cases.items():
        path = f"{base}/{name}"
        write(path)
        found = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
        for f in found:
            with open(f, "wb") as out:
                out.write(b"damaged")
            crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
        with pytest.raises(Exception):
            write(path)
        left = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
        assert sorted(left) == sorted(found)


def test_merge_rollup_recovers_from_a_crash_while_replacing(spark, monkeypatch):
    """The journal of a broken replacement is put in place by the replay, kept rows included."""
    import shutil
    base = tempfile.mkdtemp(prefix="gw-journal-")
    path = f"{base}/t"

    def rows(*hours):
        return spark.createDataFrame([(h, "dev-1") for h in hours], "h int, device_id string").select(
            F.expr("timestampadd(HOUR, h, timestamp_ntz'2024-01-01 00:00:00')").alias("bucket"), "device_id", F.col("h").alias("total"))

    w = srollups.merge_rollup(path)
    w(rows(1, 2), 0)
    taken = []
    monkeypatch.setattr(srollups, "remove", lambda s, p: taken.append(p))
    w(rows(2, 3), 1)  # the journal entry of epoch 1 stays, as if the job had died before its end
    monkeypatch.undo()
    shutil.rmtree(f"{path}/day=2024-01-01")  # and the partition was already gone
    w(rows(2, 3), 1)
    assert sorted(r.total for r in spark.read.parquet(path).collect()) == [1, 2, 3] and len(taken) == 1


def test_arriving_files_follow_arrival_whatever_the_splits(spark, monkeypatch):
    """Input of several files, row groups and splits in no order, with null times: file age follows arrival."""
    monkeypatch.setattr(catalog_streaming, "FILE_ROWS", 500, raising=False)
    src, base = tempfile.mkdtemp(prefix="gw-splits-"), tempfile.mkdtemp(prefix="gw-arrive-")
    df = spark.range(3000, numPartitions=6).select("id", F.when(F.col("id") % 100 != 7, F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("at"))
    df.write.mode("append").option("parquet.block.size", "1024").parquet(src)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        stream = catalog_streaming.arriving(spark.read.parquet(src), base, F.col("at"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert stream.isStreaming
    files = spark.read.parquet(base + "/arrived").select("id", "at", "_metadata.file_path", "_metadata.file_modification_time") \
        .groupBy("file_path", "file_modification_time").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"),
                                                            F.count_if(F.col("at").isNull()).alias("nulls")).orderBy("file_modification_time").collect()
    assert len({f["file_modification_time"] for f in files}) == len(files) >= 6 and max(f["n"] for f in files) <= 1000
    assert sum(f["n"] for f in files) == 3000 and [f["nulls"] for f in files] == [0] * (len(files) - 1) + [30]
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]) if b["lo"] is not None)


# --------------------------------------------------------------------------- expiry and refresh policies


def _files(spark, rows_by_file, schema):
    """One file per list of rows, ages in order; returns the folder."""
    from gaugeworks.sources.stored import set_ages
    src = tempfile.mkdtemp(prefix="gw-aged-") + "/in"
    for i, rows in enumerate(rows_by_file):
        tmp = tempfile.mkdtemp(prefix="gw-one-") + "/f"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
        os.makedirs(src, exist_ok=True)
        part = next(n for n in os.listdir(tmp) if n.startswith("part-"))
        os.link(f"{tmp}/{part}", f"{src}/part-{i:05d}.parquet")
    set_ages(spark, src)
    return src


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def _run_all(stream, out):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="gw-ckpt-")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _aged(spark, src, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src) \
        .withColumn("event_time", F.timestamp_millis("time_ms")).withWatermark("event_time", "1 second")


def test_replay_state_falls_after_the_window(spark):
    """Every file brings 40 new nonces and repeats; a nonce is held for its 5 s only, and results equal the batch guard."""
    rows = [[(f"{i}:{n}", 10_000 + i * 20_000 + n * 10 + r, i * 100 + n * 2 + r) for n in range(40) for r in range(2)] for i in range(6)]
    schema = "nonce string, time_ms long, event_id long"
    s = _aged(spark, _files(spark, rows, schema), schema)
    out = tempfile.mkdtemp(prefix="gw-out-") + "/t"
    q = _run_all(stateful.stream_fold(s, "nonce", ["time_ms", "event_id"], folds.replay_spec("time_ms"), expires=lambda e: e), out)
    held = _state_rows(q)
    assert max(held) <= 80 and held[-1] <= 40, held
    batch = folds.replay_guard(spark.createDataFrame([r for f in rows for r in f], schema), "nonce", "time_ms", ["time_ms", "event_id"])
    assert _rows(spark.read.parquet(out), ["event_id", "replay"]) == _rows(batch, ["event_id", "replay"])


def test_token_bucket_state_falls_after_the_ttl(spark):
    """Gateways speak in one file each and then fall silent for over 3600 s."""
    rows = [[(f"g{i}:{d}", i * 100 + d * 10 + n, 1_000_000 + i * 7_200_000 + n * 7, "free", 0.99 if n == 3 else 0.5) for d in range(5) for n in range(10)]
            + [("busy", 9000 + i, 1_000_500 + i * 7_200_000, "free", 0.2)] for i in range(5)]
    schema = "device_id string, event_id long, time_ms long, billing_tier string, compliance double"
    s = _aged(spark, _files(spark, rows, schema), schema)
    out = tempfile.mkdtemp(prefix="gw-out-") + "/t"
    q = _run_all(stateful.stream_fold(s, "device_id", ["time_ms", "event_id"], folds.token_bucket_spec(), expires=folds.bucket_expiry()), out)
    held = _state_rows(q)
    assert max(held) <= 12 and held[-1] <= 6, held
    batch = folds.token_bucket(spark.createDataFrame([r for f in rows for r in f], schema), order=["time_ms", "event_id"])
    cols = ["event_id", "allowed", "tokens_remaining", "max_tokens", "reset_at_ms"]
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def test_connections_leave_the_state_store_and_partials_time_out_alone(spark):
    rows = [[(f"c{i}", 0, 1_000_000 + i * 100_000, b"done\x00"), (f"p{i}", 0, 1_000_000 + i * 100_000, b"part")] for i in range(5)]
    rows[1].append(("p0", 1, 1_100_001, b"more\x00"))
    rows[2] += [("x", 0, 1_200_000, b"z" * 70_000), ("x", 1, 1_200_010, b"y\x00")]
    schema = "connection_id string, turn int, time_ms long, chunk binary"
    s = _aged(spark, _files(spark, rows, schema), schema)
    out = tempfile.mkdtemp(prefix="gw-out-") + "/t"
    q = _run_all(stateful.stream_reassemble(s, timeout_ms=30_000, position="turn", linger_ms=100_000), out)
    held = _state_rows(q)
    assert max(held) <= 3 and held[-1] == 1, held  # the last partial alone
    got = sorted((r.connection_id, r.event_pos, r.kind) for r in spark.read.parquet(out).collect())
    want = [(f"c{i}", 0, "message") for i in range(5)] + [("p0", 1, "message"), ("x", 0, "partial_message_too_large"), ("x", 1, "closed")] + \
           [(f"p{i}", 1, "partial_message_timeout") for i in range(4)]
    assert got == sorted(want)


def _telemetry_file(hours):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)
    return [(at + dt.timedelta(hours=h), d, v) for h, d, v in hours]


_TEL = "time timestamp_ntz, device_id string, metric_value decimal(18,2)"


def _policy_run(spark, src, view, out, ckpt, schema=_TEL):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = srollups.run_policy_stream(spark, s, view, out, ckpt)
    q.awaitTermination()


def test_no_bucket_is_visible_before_its_end_offset(spark):
    """Hourly view: a bucket appears an hour after its end; a late reading corrects it; one behind start_offset does not."""
    from decimal import Decimal as D
    src, out, ckpt = tempfile.mkdtemp(prefix="gw-pol-"), tempfile.mkdtemp(prefix="gw-pol-out-") + "/v", tempfile.mkdtemp(prefix="gw-ckpt-")
    steps = [([(0.1, "a", D(1)), (0.5, "b", D(2)), (1.5, "a", D(3))], set()),
             ([(2.0, "a", D(4))], {(0, "a", 1, 1.0), (0, "b", 1, 2.0)}),
             ([(0.7, "a", D(10)), (2.9, "b", D(5))], {(0, "a", 2, 11.0), (0, "b", 1, 2.0)}),
             ([(80.0, "a", D(6))], {(0, "a", 2, 11.0), (0, "b", 1, 2.0), (1, "a", 1, 3.0), (2, "a", 1, 4.0), (2, "b", 1, 5.0)}),
             ([(1.2, "a", D(100)), (81.0, "c", D(7))], {(0, "a", 2, 11.0), (0, "b", 1, 2.0), (1, "a", 1, 3.0), (2, "a", 1, 4.0), (2, "b", 1, 5.0)})]
    for i, (hours, want) in enumerate(steps):
        one = tempfile.mkdtemp(prefix="gw-one-") + "/f"
        spark.createDataFrame(_telemetry_file(hours), _TEL).coalesce(1).write.parquet(one)
        os.link(f"{one}/" + next(n for n in os.listdir(one) if n.startswith("part-")), f"{src}/part-{i}.parquet")
        os.utime(f"{src}/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        _policy_run(spark, src, "1h", out, ckpt)
        rows = spark.read.parquet(out).collect() if os.path.exists(out) and any(n.startswith("day=") for n in os.listdir(out)) else []
        got = {((r.bucket.day - 1) * 24 + r.bucket.hour, r.device_id, r.sample_count, r.total_value) for r in rows}
        assert got == want, (i, got)


def test_months_are_summed_behind_daily_state(spark):
    import datetime as dt
    from decimal import Decimal as D
    days = [[(dt.datetime(2024, 1, 5), "a", D(1)), (dt.datetime(2024, 1, 31, 23), "a", D(2)), (dt.datetime(2024, 2, 1), "a", D(4))],
            [(dt.datetime(2024, 1, 20), "b", D(8)), (dt.datetime(2024, 2, 29, 23, 59), "a", D(16)), (dt.datetime(2024, 3, 1), "a", D(32))],
            [(dt.datetime(2024, 1, 6), "a", D(64)), (dt.datetime(2024, 4, 1), "b", D(128))]]
    src, out, ckpt = _files(spark, days, _TEL), tempfile.mkdtemp(prefix="gw-mo-") + "/v", tempfile.mkdtemp(prefix="gw-ckpt-")
    _policy_run(spark, src, "1mo", out, ckpt)
    got = {(r.bucket.month, r.device_id, r.sample_count, r.total_value) for r in spark.read.parquet(out).collect()}
    # January and February are closed for a month on the first of March and April; March is not
    assert got == {(1, "a", 3, 67.0), (1, "b", 1, 8.0), (2, "a", 2, 20.0)}


def test_policy_sink_replays_an_epoch_without_effect(spark):
    import datetime as dt
    out = tempfile.mkdtemp(prefix="gw-rep-") + "/v"
    sink = srollups.policy_sink(out, "1h")
    schema = "bucket timestamp_ntz, device_id string, sample_count long, _aggregate_watermark timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([(at, "a", 1, at + dt.timedelta(hours=3)), (at + dt.timedelta(hours=3), "b", 1, at + dt.timedelta(hours=3))], schema)
    two = spark.createDataFrame([(at + dt.timedelta(hours=9), "b", 2, at + dt.timedelta(hours=9))], schema)
    for epoch, batch in ((0, one), (0, one), (1, two), (1, two)):
        sink(batch, epoch)
    assert {(r.bucket.hour, r.device_id) for r in spark.read.parquet(out).collect()} == {(0, "a"), (3, "b")}
    assert spark.read.parquet(out).count() == 2


def test_many_keys_share_the_buckets_of_the_state_store(spark):
    """2500 nonces alive take at most a state row per bucket; big and null whole numbers come out as they went in."""
    big = 2 ** 53
    rows = [[(f"n{n}" if n else None, 10_000 + f * 2_000 + n % 7, big + f * 10_000 + n if n % 5 else None) for n in range(2500)] for f in range(4)]
    schema = "nonce string, time_ms long, event_id long"
    s = _aged(spark, _files(spark, rows, schema), schema)
    out = tempfile.mkdtemp(prefix="gw-out-") + "/t"
    q = _run_all(stateful.stream_fold(s, "nonce", ["time_ms", "event_id"], folds.replay_spec("time_ms"), expires=lambda e: e), out)
    assert 0 < max(_state_rows(q)) <= 1024
    got = sorted((r.nonce or "", r.time_ms, r.event_id or 0, r.replay) for r in spark.read.parquet(out).collect())
    want = sorted((n or "", t, e or 0, f in (1, 2)) for f, part in enumerate(rows) for n, t, e in part)
    assert got == want


def test_entities_of_a_bucket_keep_their_own_timers(spark):
    """2500 entities in few state rows: a timer fires for the entity that waits and for no other of its bucket."""
    from gaugeworks.streaming.resync import resync_requests
    t0 = 1_700_000_000_000
    waits = [f"w{n}" for n in range(2500)]
    rows = [[(e, "GAP_DETECTED", t0 + i) for i, e in enumerate(waits)],
            [(e, "PENDING", t0 + 30_000 + i) for i, e in enumerate(waits) if i % 3 == 0] + [(None, "GAP_DETECTED", t0 + 59_000)],
            [("z", "TENTATIVE", t0 + 64_000)], [("z", "TENTATIVE", t0 + 300_000)]]
    schema = "entity string, to_state string, time_ms long"
    s = _aged(spark, _files(spark, rows, schema), schema)
    out = tempfile.mkdtemp(prefix="gw-out-") + "/t"
    q = _run_all(resync_requests(s), out)
    assert 0 < max(_state_rows(q)) <= 1024
    got = sorted((r.entity or "", r.at_ms) for r in spark.read.parquet(out).where("kind = 'resync_request'").collect())
    assert got == sorted([(e, t0 + i + 60_000) for i, e in enumerate(waits) if i % 3] + [("", t0 + 119_000)])


def test_a_streams_partitions_follow_the_cores_not_the_whole_input(spark):
    """With a shuffle count set for a large input, a micro-batch still commits a few state partitions, and the setting is left as it was."""
    import datetime as dt
    from decimal import Decimal as D
    src = _files(spark, [[(dt.datetime(2024, 1, 1), "a", D(1))], [(dt.datetime(2024, 1, 2), "a", D(2))]], _TEL)
    s = spark.readStream.schema(_TEL).option("maxFilesPerTrigger", 1).parquet(src)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        q = srollups.run_policy_stream(spark, s, "1h", tempfile.mkdtemp(prefix="gw-few-") + "/v")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "300"
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    used = {p["stateOperators"][0]["numShufflePartitions"] for p in q.recentProgress if p["stateOperators"]}
    assert used == {2 * spark.sparkContext.defaultParallelism}


def test_arriving_files_are_bounded_in_bytes_and_cut_equal_times(spark, monkeypatch):
    """Wide rows at one time, far under FILE_ROWS: files stay near FILE_BYTES, and a key's rows of that time share a file."""
    monkeypatch.setattr(catalog_streaming, "FILE_BYTES", 50_000, raising=False)
    base = tempfile.mkdtemp(prefix="gw-wide-")
    df = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 500).alias("key"), F.lit(7).cast("long").alias("at"), F.expr("repeat('x', 1000)").alias("text"))
    catalog_streaming.arriving(df, base, F.col("at"), ties=F.xxhash64("key"))
    rows = spark.read.parquet(base + "/arrived").select("key", "_metadata.file_path").groupBy("file_path").agg(
        F.count("*").alias("n"), F.collect_set("key").alias("keys")).collect()
    assert sum(r.n for r in rows) == 1000 and max(r.n for r in rows) <= 200
    assert sum(len(r["keys"]) for r in rows) == 500

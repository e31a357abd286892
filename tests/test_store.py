"""Telemetry store: partitioned writes, appends, retention, layout rewrite."""

import tempfile

from pyspark.sql import functions as F

from gaugeworks.operators import billing
from gaugeworks.sources import tables
from gaugeworks.sources.telemetry_store import (compact_layout, compression_ratio, drop_expired_partitions,
                                                read_telemetry, retention_filter, write_telemetry)

from conftest import SF_SMALL


def _tel(spark):
    return tables.telemetry(spark, SF_SMALL).select("time", "device_id", "metric_id", "metric_value", "region",
                                                    "ingested_at")


def test_append_and_read_back(spark):
    path = tempfile.mkdtemp(prefix="gw-s1-") + "/t"
    tel = _tel(spark)
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    write_telemetry(tel.where(F.col("time") < half), path)
    write_telemetry(tel.where(F.col("time") >= half).drop("ingested_at"), path)  # stamped at the sink
    back = read_telemetry(spark, path)
    assert back.count() == tel.count()
    assert back.where(F.col("ingested_at").isNull()).count() == 0
    assert {"day", "region_bucket"} <= set(back.columns)


def test_default_region(spark):
    path = tempfile.mkdtemp(prefix="gw-s1-") + "/t"
    df = _tel(spark).limit(5).withColumn("region", F.lit(None).cast("string"))
    write_telemetry(df, path)
    assert {r.region for r in read_telemetry(spark, path).collect()} == {"default"}


def test_retention_filter_and_partition_drop(spark):
    path = tempfile.mkdtemp(prefix="gw-s13-") + "/t"
    tel = _tel(spark)
    write_telemetry(tel, path)
    kept = retention_filter(read_telemetry(spark, path), "2024-01-31 00:00:00", 20)
    expected = tel.where(F.to_date("time") >= F.lit("2024-01-11").cast("date")).count()
    assert kept.count() == expected
    dropped = drop_expired_partitions(spark, path, "2024-01-31 00:00:00", 20)
    assert dropped and max(dropped) == "2024-01-10"
    assert read_telemetry(spark, path).count() == expected


def test_compacted_layout_keeps_rows_and_shrinks(spark):
    src = tempfile.mkdtemp(prefix="gw-s3-") + "/src"
    dst = tempfile.mkdtemp(prefix="gw-s3-") + "/dst"
    # 1000 repetitive rows one second apart, like the reference's compression test.
    rows = spark.range(1000).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("int"))).alias("time"),
        F.lit("dev-001").alias("device_id"), F.lit(42).alias("metric_id"),
        F.lit(100.5).cast("decimal(18,2)").alias("metric_value"), F.lit("us-east-1").alias("region"),
        F.lit(None).cast("timestamp_ntz").alias("ingested_at"))
    rows.withColumn("raw_payload", F.expr("repeat('x', 200)")).write.option("compression", "none") \
        .option("parquet.enable.dictionary", "false").partitionBy("region").parquet(src)
    raw = spark.read.parquet(src).withColumn("day", F.to_date("time")).withColumn("region_bucket", F.lit(0))
    raw.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false") \
        .partitionBy("day", "region_bucket").parquet(src + "2")
    rep = compact_layout(spark, src + "2", dst, "2030-01-01").first()
    assert spark.read.parquet(dst).count() == 1000
    assert rep.compression_ratio_pct > 85
    assert spark.range(1).select(compression_ratio(F.lit(100), F.lit(10)).alias("r")).first().r == 90.0


def test_known_state_guard(spark):
    df = spark.createDataFrame([("c1", "OPEN"), ("c2", "BOGUS")], "id string, state string")
    assert [r.id for r in billing.guard_known_state(df, mode="quarantine").collect()] == ["c1"]
    assert [r.id for r in billing.unknown_states(df).collect()] == ["c2"]
    import pytest
    with pytest.raises(Exception):
        billing.guard_known_state(df).collect()


def test_billing_store_weekly_chunks_and_pruning(spark):
    from gaugeworks.sources.telemetry_store import billing_range, write_billing_records
    path = tempfile.mkdtemp(prefix="gw-s4-") + "/b"
    recs = tables.billing_records(spark, SF_SMALL)
    write_billing_records(recs, path)
    back = spark.read.parquet(path)
    assert back.count() == recs.count()
    sel = billing_range(back, "1998-01-01 00:00:00", "1998-02-01 00:00:00")
    p = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in p and "chunk" in p[p.index("PartitionFilters"):].split("]")[0]
    expected = recs.where((F.col("time") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                          & (F.col("time") < F.lit("1998-02-01").cast("timestamp_ntz"))).count()
    assert sel.count() == expected > 0

"""Input tables and the telemetry-shaped views derived from them.

The driver ships TPC-H-like Parquet tables; the mapping below turns them into
the data model of a metering backend (telemetry readings, billing records,
accounts, an event log, a ledger, load-test outcomes, signed payloads). Every
view is a projection over a single scan, so Catalyst keeps column pruning and
pushes filters on the source columns (``ts``, ``user_id`` ...) into the
Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Event type to metric id.
METRIC_IDS = {"click": 1, "view": 2, "purchase": 3, "signup": 4, "error": 5}
# Order status to billing status.
BILLING_STATUS = {"F": "settled", "O": "pending", "P": "failed"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (the folder holds one file per table, so
    the file name selects the table)."""
    schema = read_table(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(sf_dir)


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _metric_id(event_type: Column) -> Column:
    expr = None
    for name, code in METRIC_IDS.items():
        expr = (F.when(event_type == name, F.lit(code)) if expr is None
                else expr.when(event_type == name, F.lit(code)))
    return expr


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``telemetry(time, device_id, metric_id, metric_value, region, tenant_id, ...)``.

    ``metric_value`` is ``decimal(18,2)`` so sums are exact and independent of
    the order in which partial aggregates are merged.
    """
    return telemetry_from(read_table(spark, sf_dir, "events"))


def telemetry_from(ev: DataFrame) -> DataFrame:
    """The telemetry projection of an ``events`` DataFrame (batch or stream)."""
    k = _k(F.col("props"))
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("time"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        _metric_id(F.col("event_type")).alias("metric_id"),
        F.col("value").cast("decimal(18,2)").alias("metric_value"),
        F.concat(F.lit("r"), (F.col("user_id") % 8).cast("string")).alias("region"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        k.alias("k"),
        (F.col("ts") + F.make_dt_interval(secs=k)).alias("ingested_at"),
        F.col("user_id"),
        F.col("event_type"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger stream: ``sequence`` with gaps, arrival order ``(arrival_ts, arrival_id)``."""
    return ledger_from(read_table(spark, sf_dir, "events"))


def ledger_from(ev: DataFrame) -> DataFrame:
    return (ev.where(_k(F.col("props")) % 25 != 0)
              .select(F.lit("ledger").alias("stream_id"),
                      F.col("event_id").alias("sequence"),
                      F.col("ts").alias("arrival_ts"),
                      F.col("event_id").alias("arrival_id")))


def billing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_records_from(read_table(spark, sf_dir, "orders"))


def billing_records_from(o: DataFrame) -> DataFrame:
    """The billing projection of an ``orders`` DataFrame (batch or stream)."""
    status = None
    for code, name in BILLING_STATUS.items():
        status = (F.when(F.col("o_orderstatus") == code, F.lit(name)) if status is None
                  else status.when(F.col("o_orderstatus") == code, F.lit(name)))
    account = F.concat(F.lit("acct-"), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderdate").alias("time"),
        account.alias("account_id"),
        F.concat(F.lit("dev-"), (F.col("o_custkey") % 150).cast("string")).alias("device_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("usage_amount"),
        status.alias("status"),
        F.concat(account, F.lit(":"), F.date_format(F.col("o_orderdate"), "yyyy-MM")).alias("cycle_id"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    local = F.round(F.col("c_acctbal") * 100).cast("bigint") * F.lit(100000)
    return c.select(
        F.concat(F.lit("acct-"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("G"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("address"),
        local.alias("local_balance"),
        (local + F.when(F.col("c_custkey") % 7 == 0, F.lit(1)).otherwise(F.lit(0))).alias("onchain_balance"),
        F.col("c_custkey"),
        F.col("c_nationkey"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("tenant_id"),
                    F.col("turn").alias("arrival"), F.col("role").alias("event_type"),
                    F.col("text").alias("payload"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("time"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        F.col("value").alias("latency_ms"),
        F.when(et == "error", "error").when(et == "signup", "rejected").otherwise("accepted").alias("outcome"),
        et.alias("profile"),
        _k(F.col("props")).alias("k"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads_from(read_table(spark, sf_dir, "events"))


def payloads_from(ev: DataFrame) -> DataFrame:
    k = _k(F.col("props"))
    ts_ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return ev.select(
        F.col("event_id"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), (k % 10).cast("string")).alias("nonce"),
        F.floor(ts_ms).cast("bigint").alias("ts_ms"),
        (F.floor(ts_ms).cast("bigint") + k * 100).alias("received_ms"),
        k.alias("k"),
    )

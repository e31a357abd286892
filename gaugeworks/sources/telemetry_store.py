"""Telemetry and billing stores as partitioned Parquet.

Layout: ``day=YYYY-MM-DD/region_bucket=N/part-*.parquet``. A range read that
filters on ``time`` also filters on ``day`` so whole directories are pruned;
``region_bucket`` spreads a day over 8 directories like the source's 8 hash
partitions on region. Inside a file rows are sorted by device, region and
newest time first, so Parquet row-group statistics skip most row groups of a
device read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION_BUCKETS = 8
TELEMETRY_COLUMNS = ["time", "device_id", "metric_id", "metric_value", "raw_payload", "ingested_at", "region"]


def with_partition_columns(df: DataFrame, region_buckets: int = REGION_BUCKETS) -> DataFrame:
    """Add ``day`` and ``region_bucket``; a missing region becomes ``default``."""
    return (df.withColumn("region", F.coalesce(F.col("region"), F.lit("default")))
              .withColumn("day", F.to_date("time"))
              .withColumn("region_bucket", F.pmod(F.hash("region"), F.lit(region_buckets))))


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append readings; ``ingested_at`` is stamped here, at the sink."""
    if "ingested_at" not in df.columns:
        df = df.withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
    out = with_partition_columns(df)
    # One shuffle groups each (day, region bucket) into few files, split by
    # size where one is large (rebalance); the sort inside a task clusters a
    # device's rows for row-group skipping.
    (out.hint("rebalance", "day", "region_bucket")
        .sortWithinPartitions("device_id", "region", F.col("time").desc())
        .write.mode(mode).partitionBy("day", "region_bucket")
        .option("compression", "zstd").parquet(path))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def time_range(df: DataFrame, start: str, end: str, time_col: str = "time", day_col: str = "day") -> DataFrame:
    """Half-open time filter plus the matching ``day`` filter for partition pruning."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    cond = (F.col(time_col) >= s) & (F.col(time_col) < e)
    if day_col in df.columns:
        cond = cond & (F.col(day_col) >= F.to_date(s)) & (F.col(day_col) <= F.to_date(e))
    return df.where(cond)


def retention_filter(df: DataFrame, now: str | Column, retention_days: int = 365,
                     time_col: str = "time") -> DataFrame:
    """Keep rows whose day is within ``retention_days`` of ``now``.

    On a day-partitioned table the predicate on ``day`` drops whole
    directories; ``drop_expired_partitions`` deletes them physically.
    """
    now_col = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    boundary = F.to_date(now_col - F.make_dt_interval(days=F.lit(retention_days)))
    day = F.col("day") if "day" in df.columns else F.to_date(time_col)
    return df.where(day >= boundary)


def compact_layout(spark: SparkSession, src: str, dst: str, older_than_day: str) -> DataFrame:
    """S3: rewrite aged partitions clustered by device and region, newest first.

    ``dst`` gets the days before ``older_than_day`` only; ``src`` keeps all, and
    ``read_layout`` gives the whole table from both. Returns a size report
    ``(bytes_before, bytes_after)`` from file metadata of the same aged days on
    both sides.
    """
    df = spark.read.parquet(src).where(F.col("day") < F.lit(older_than_day).cast("date"))
    (df.hint("rebalance", "day", "region_bucket")
       .sortWithinPartitions("device_id", "region", F.col("time").desc())
       .write.mode("overwrite").partitionBy("day", "region_bucket")
       .option("compression", "zstd").parquet(dst))
    # binaryFile reads file content only when the column is selected.
    sizes = None
    for side, path in (("before", src), ("after", dst)):
        day = F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1)
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .where(F.col("path").endswith(".parquet") & (day < F.lit(str(older_than_day))))
                 .select(F.lit(side).alias("side"), "length"))
        sizes = files if sizes is None else sizes.unionByName(files)
    rep = sizes.agg(F.sum(F.when(F.col("side") == "before", F.col("length"))).alias("bytes_before"),
                    F.sum(F.when(F.col("side") == "after", F.col("length"))).alias("bytes_after"))
    return rep.select("bytes_before", "bytes_after",
                      compression_ratio(F.col("bytes_before"), F.col("bytes_after")).alias("compression_ratio_pct"))


def read_layout(spark: SparkSession, src: str, aged: str, older_than_day: str) -> DataFrame:
    """The whole table: days before ``older_than_day`` from the rewritten layout, later ones from ``src``."""
    split = F.lit(older_than_day).cast("date")
    return spark.read.parquet(aged).where(F.col("day") < split).unionByName(spark.read.parquet(src).where(F.col("day") >= split))


def compression_ratio(before_bytes: Column, after_bytes: Column) -> Column:
    """``(1 - after/before) * 100``."""
    return (F.lit(1.0) - after_bytes / before_bytes) * 100


def drop_expired_partitions(spark: SparkSession, path: str, now: str, retention_days: int = 365) -> list[str]:
    """Delete ``day=`` directories older than the retention boundary.

    Only directory names are listed (no data is read); deletion goes through
    the Hadoop FileSystem of the path, so it works on any shared file system
    Spark can write to. Returns the deleted partition values.
    """
    import datetime as dt
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    boundary = (dt.datetime.fromisoformat(now) - dt.timedelta(days=retention_days)).date()
    dropped = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("day="):
            day = dt.date.fromisoformat(name[4:])
            if day < boundary:
                fs.delete(status.getPath(), True)
                dropped.append(name[4:])
    return sorted(dropped)


BILLING_CHUNK_DAYS = 7


def write_billing_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Billing records in 7-day chunks of ``time`` (``chunk`` = days since
    the epoch // 7), clustered by account and newest time first inside a
    chunk; a missing status is ``pending``."""
    out = (df.withColumn("status", F.coalesce(F.col("status"), F.lit("pending")))
             .withColumn("chunk", F.floor(F.unix_date(F.to_date("time")) / BILLING_CHUNK_DAYS).cast("int")))
    (out.hint("rebalance", "chunk")
        .sortWithinPartitions("account_id", F.col("time").desc())
        .write.mode(mode).partitionBy("chunk").option("compression", "zstd").parquet(path))


def billing_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open time filter plus the ``chunk`` filter for partition pruning."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    lo = F.floor(F.unix_date(F.to_date(s)) / BILLING_CHUNK_DAYS)
    hi = F.floor(F.unix_date(F.to_date(e)) / BILLING_CHUNK_DAYS)
    return df.where((F.col("time") >= s) & (F.col("time") < e) & (F.col("chunk") >= lo) & (F.col("chunk") <= hi))


# --------------------------------------------------------------------------- maintenance by age

# Age after which a table's partitions are rewritten; the views' ages are in their policies.
COMPRESS_AFTER = {"telemetry": "7 days", "billing_records": "30 days"}


def aged_before(partition: str, width: str, now, age: str) -> Column:
    """Whether a partition (``day`` of a day or month, or ``chunk`` of seven days) ended ``age`` before ``now``."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{age}'")
    if partition == "chunk":
        end = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("chunk") + 1) * BILLING_CHUNK_DAYS)
    else:
        end = F.add_months("day", 1) if width == "month" else F.date_add("day", 1)
    return end.cast("timestamp_ntz") <= limit.cast("timestamp_ntz")


def compact_aged(spark: SparkSession, path: str, name: str, partition: str, now, age: str, order: list[Column], width: str = "day") -> DataFrame:
    """S3: rewrite the partitions of a stored table that are older than ``age``, clustered by ``order`` and compressed with zstd.

    Aged partitions that were not rewritten yet are written beside the table first; each then takes the old one's
    place by a rename, so data is copied once. A crash leaves either the old or the new partition in place or the new
    one in the journal, from which the next run puts it in place before anything else. What was rewritten is a
    small table beside the data. Returns one row ``(table_name, partitions, bytes_before, bytes_after, compression_ratio_pct)``.
    """
    from .stored import entries, epochs, finished, read_epoch, remove, replace_parts, size_of, write_epoch

    journal, marks = f"{path.rstrip('/')}-compacting", f"{path.rstrip('/')}-compacted"
    if finished(spark, journal):
        replace_parts(spark, journal, path)
    remove(spark, journal)
    done = read_epoch(spark, marks)
    before = after = 0
    parts: list[str] = []
    if entries(spark, path):
        table = spark.read.parquet(path)
        keys = [c for c in table.columns if c in (partition, "region_bucket")]
        names = table.select(F.concat(F.lit(f"{partition}="), F.col(partition).cast("string")).alias("part"), partition).distinct().where(aged_before(partition, width, now, age))
        if done is not None:
            names = names.join(done, "part", "left_anti")
        parts = sorted(r["part"] for r in names.select("part").collect())  # one name per aged partition
    if parts:
        before = sum(size_of(spark, f"{path}/{p}") for p in parts)
        old = table.where(F.concat(F.lit(f"{partition}="), F.col(partition).cast("string")).isin(parts))
        old.hint("rebalance", *keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).option("compression", "zstd").parquet(journal)
        replace_parts(spark, journal, path)
        after = sum(size_of(spark, f"{path}/{p}") for p in parts)
        mark = spark.createDataFrame([(p,) for p in parts], "part string")
        write_epoch(mark if done is None else done.unionByName(mark), marks, (epochs(spark, marks) or [-1])[-1] + 1)
        remove(spark, journal)
    row = spark.createDataFrame([(name, len(parts), before, after)], "table_name string, partitions long, bytes_before long, bytes_after long")
    return row.withColumn("compression_ratio_pct", F.when(F.col("bytes_before") > 0, compression_ratio(F.col("bytes_before"), F.col("bytes_after"))))


# --------------------------------------------------------------------------- tenants


def schema_of(tenant_id: str) -> str:
    """P13 for one id: its schema name; an id without a usable character raises."""
    import re

    from ..operators.validation import TENANT_INVALID, TENANT_MAX_CHARS, TENANT_PREFIX
    clean = re.sub(r"[^a-zA-Z0-9_]", "", tenant_id or "")[:TENANT_MAX_CHARS]
    if not clean:
        raise ValueError(TENANT_INVALID)
    return TENANT_PREFIX + clean


def write_tenants(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store rows partitioned by tenant schema and day; an invalid tenant id raises."""
    from ..operators.validation import tenant_schema_name
    out = df.withColumn("tenant_schema", tenant_schema_name(F.col("tenant_id"), on_invalid="raise")).withColumn("day", F.to_date("time"))
    out.hint("rebalance", "tenant_schema", "day").sortWithinPartitions("device_id", F.col("time").desc()) \
       .write.mode(mode).partitionBy("tenant_schema", "day").option("compression", "zstd").parquet(path)


class TenantRequired(PermissionError):
    """A read of tenant data that is not bound to one tenant."""


def tenant_scan(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """Rows of a tenant store that satisfy ``condition``, which has to name one tenant.

    The optimized plan is asked, not the caller: without an equality on ``tenant_schema`` among the
    scan's partition filters (a condition on other columns, on several tenants, or one that an OR loosens) it raises.
    """
    rows = spark.read.parquet(path).where(condition)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    import re
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)
    bound = filters is not None and any(re.fullmatch(r"\(tenant_schema#\d+ = [^()]+\)", f.strip()) for f in filters.group(1).split(", "))
    if not bound and "LocalTableScan <empty>" not in plan:
        raise TenantRequired("every read of tenant data has to name one tenant")
    return rows

"""Trace CSV source (S7): ``timestampMs[,deviceId]`` lines.

Rules: an optional header (a first line whose first field is not a number),
blank lines skipped, a non-numeric timestamp on a data line raises, a
missing device id becomes ``trace-device-{index}`` (0-based over data
rows), offsets are relative to the minimum timestamp, output sorted by
offset. Data-row positions come from per-chunk counts plus offsets, so the
file is numbered in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan

# Name given to a trace row without a device id (row index follows).
MISSING_DEVICE_PREFIX = "trace-device-"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order key: ``monotonically_increasing_id`` grows with the
    file offset (partition index in the high bits), so it sorts in file order;
    the chunk is the input partition."""
    return (spark.read.text(path)
                 .select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))
                 .withColumn("line_chunk", F.shiftright("line_no", 33)))


def parse_trace(lines: DataFrame, on_bad: str = "raise") -> DataFrame:
    """``(line_no, text[, line_chunk])`` -> ``(row_index, timestamp_ms, device_id, offset_ms)``."""
    if "line_chunk" not in lines.columns:
        lines = lines.withColumn("line_chunk", F.floor(F.col("line_no") / 1_000_000))
    t = F.trim(F.col("text"))
    first_field = F.trim(F.split(t, ",").getItem(0))
    ts = first_field.try_cast("double")
    # An empty first field counts as 0.
    ts = F.when(first_field == "", F.lit(0.0)).otherwise(ts)
    # The header test needs only the first line that is not blank: one number fetched to the driver.
    first_no = lines.where(t != "").agg(F.min("line_no")).first()[0]
    d = lines.where((t != "") & ~((F.col("line_no") == F.lit(first_no)) & ts.isNull()))
    if on_bad == "raise":
        ts = F.when(ts.isNull(), F.raise_error(F.concat(F.lit("Invalid trace timestamp: "), first_field))).otherwise(ts)
    d = d.select("line_no", "line_chunk", ts.alias("timestamp_ms"),
                 F.nullif(F.trim(F.get(F.split(t, ","), 1)), F.lit("")).alias("device_raw"))
    if on_bad != "raise":
        d = d.where(F.col("timestamp_ms").isNotNull())
    # rows are counted per chunk of lines; the file is one key, its chunks are one row each
    d = scan.row_number_in_order(d.withColumn("_file", F.lit(1)), ["_file"], ["line_no"], chunk=F.col("line_chunk"), out="_rn")
    min_ts = d.agg(F.min("timestamp_ms")).first()[0]
    rows = d.select((F.col("_rn") - 1).alias("row_index"), "timestamp_ms",
                    F.coalesce("device_raw", F.concat(F.lit(MISSING_DEVICE_PREFIX), (F.col("_rn") - 1).cast("string")))
                    .alias("device_id"),
                    (F.col("timestamp_ms") - F.lit(min_ts)).alias("offset_ms"))
    return rows.orderBy("offset_ms", "row_index")

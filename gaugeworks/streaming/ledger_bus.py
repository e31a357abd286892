"""Ledger event log (S11): durable append, group consumption with replay of
unacknowledged entries, acknowledgement after processing, length cap.

The log is a folder of Parquet files ``(seq, payload map<string,string>)`` in order of
their names, at most ``SEGMENT`` entries each. A consumer is a Structured Streaming
query over that folder: its checkpoint is the consumer-group position, a
micro-batch that was not committed is replayed after a restart (the
pending-entries list), and the commit that follows a successful
``foreachBatch`` is the acknowledgement. Pair it with an idempotent sink for an
exactly-once effect (R11).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import entries, modified, move_file, read_if_exists, read_lines, remove, set_time

# Fixed value: read batch size.
DEFAULT_COUNT = 64
#: Entries of a log file, at most, unless ``publish`` is told otherwise.
SEGMENT = 64

LOG_SCHEMA = "seq long, payload map<string,string>"


def publish(spark: SparkSession, path: str, payloads: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Append ``payloads`` (a ``payload`` map column plus an ``order`` column)
    with sequence numbers continuing after the log's current maximum.

    The numbered rows are range-partitioned and written in files of ``segment`` entries beside
    the log; each file then moves into it under a name that sorts by sequence, with a
    later time than the file before, since a consumer reads older files first.
    """
    from ..functions.scan import global_row_number

    log = read_if_exists(spark, path)
    base = (log.agg(F.max("seq")).first()[0] or 0) if log is not None else 0
    rows = global_row_number(payloads, ["order"], out="_rn").select((F.col("_rn") + F.lit(base)).alias("seq"), "payload")
    fresh = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # whole segments a task, so every file but the last is full
    rows.repartitionByRange(parts, F.floor((F.col("seq") - F.lit(base + 1)) / segment)).sortWithinPartitions("seq").write.option("maxRecordsPerFile", segment).parquet(fresh)
    at = max([*modified(spark, path), *modified(spark, fresh)], default=0) // 1000 * 1000
    for i, n in enumerate(entries(spark, fresh)):
        name = f"{path}/{base:020d}-{i:010d}.parquet"
        move_file(spark, f"{fresh}/{n}", name)
        set_time(spark, name, at + 1000 * (i + 1))
    remove(spark, fresh)
    return spark.read.schema(LOG_SCHEMA).parquet(path).where(F.col("seq") > base)


def consume(spark: SparkSession, path: str, checkpoint: str, handler, count: int = DEFAULT_COUNT,
            available_now: bool = True, segment: int = SEGMENT):
    """Start a consumer; ``handler(batch_df, epoch_id)`` processes each read.

    A read holds at most ``count`` entries, or one file if the log's ``segment`` is larger: so many
    whole files are admitted.
    """
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max(1, count // segment)).parquet(path)
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")
    return w.start()


def pending_count(spark: SparkSession, checkpoint: str) -> int:
    """Entries delivered to the consumer of ``checkpoint`` but not acknowledged: those of reads that are planned and not committed."""
    planned = {int(n) for n in entries(spark, f"{checkpoint}/offsets") if n.isdigit()}
    acknowledged = {int(n) for n in entries(spark, f"{checkpoint}/commits") if n.isdigit()}
    files = []
    for read in planned - acknowledged:
        for line in read_lines(spark, f"{checkpoint}/sources/0/{read}"):
            if line.startswith("{"):
                files.append(json.loads(line)["path"])
    return spark.read.schema(LOG_SCHEMA).parquet(*files).count() if files else 0


def trim(spark: SparkSession, path: str, max_len: int, consumed: int) -> list[str]:
    """Retention job: delete whole files whose entries all fall below the newest
    ``max_len`` and were all read: ``consumed`` is the sequence the slowest
    consumer has acknowledged.

    Per-file sequence ranges come from one aggregate over the log (one row
    per file); files are removed through the Hadoop FileSystem of the path.
    """
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    top = log.agg(F.max("seq")).first()[0]
    if top is None:
        return []
    floor_seq = min(top - max_len, consumed)
    files = (log.groupBy(F.input_file_name().alias("file")).agg(F.max("seq").alias("hi"))
                .where(F.col("hi") <= floor_seq).select("file"))
    removed = []
    for r in files.toLocalIterator():
        remove(spark, r.file)
        removed.append(r.file)
    return removed

"""Ordered scans per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts every row of a key in
one task; if one stream or tenant holds a third of all rows, that task holds
a third of the data. These helpers split each key's order into chunks (for
example the hour of the arrival time), run the window inside
``(key, chunk)``, and carry what earlier chunks contribute through a small
per-chunk summary table (one row per key and chunk). The summary's window
runs over chunk counts, not rows, so it stays small at any data size.

``chunk`` must be non-decreasing along the order (derive it from the leading
order column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _with_chunk(df: DataFrame, chunk: Column | None) -> DataFrame:
    return df.withColumn("_chunk", chunk if chunk is not None else F.lit(0))


def running_max_before(df: DataFrame, keys, order: Sequence[str], value: str,
                       chunk: Column | None = None, out: str = "prev_max") -> DataFrame:
    """Add ``out`` = max of ``value`` over earlier rows of the same key (NULL for the first)."""
    keys = _cols(keys)
    d = _with_chunk(df, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in_max", F.max(value).over(inner))
    summary = d.groupBy(*keys, "_chunk").agg(F.max(value).alias("_chunk_max"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.max("_chunk_max").over(across).alias("_carry_max"))
    return (d.join(carry, [*keys, "_chunk"], "left")
             .withColumn(out, F.greatest("_carry_max", "_in_max"))
             .drop("_chunk", "_in_max", "_carry_max"))


def running_sum_before(df: DataFrame, keys, order: Sequence[str], value: str | Column,
                       chunk: Column | None = None, out: str = "prev_sum") -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same key (0 for the first)."""
    keys = _cols(keys)
    d = _with_chunk(df, chunk).withColumn("_add", F.col(value) if isinstance(value, str) else value)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in_sum", F.sum("_add").over(inner))
    summary = d.groupBy(*keys, "_chunk").agg(F.sum("_add").alias("_chunk_sum"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.sum("_chunk_sum").over(across).alias("_carry_sum"))
    return (d.join(carry, [*keys, "_chunk"], "left")
             .withColumn(out, (F.coalesce("_carry_sum", F.lit(0)) + F.coalesce("_in_sum", F.lit(0))).cast("bigint"))
             .drop("_chunk", "_add", "_in_sum", "_carry_sum"))


def even_chunks(lead: Column, low: float, high: float, rows: int, per_chunk: int) -> Column:
    """Chunk number of a numeric order column: equal ranges of ``[low, high]``, about ``per_chunk`` rows each."""
    n = max(1, -(-rows // per_chunk))
    width = (high - low) / n
    return F.floor((lead - F.lit(low)) / F.lit(width)).cast("bigint") if n > 1 and width > 0 else F.lit(0)


def row_number_in_order(df: DataFrame, keys, order: Sequence[str], chunk: Column | None = None,
                        out: str = "rn") -> DataFrame:
    """Add ``out`` = 1-based position of the row in its key's order (dense, no ties)."""
    keys = _cols(keys)
    d = _with_chunk(df, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumn("_in_rn", F.row_number().over(inner))
    summary = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    return (d.join(offsets, [*keys, "_chunk"], "left")
             .withColumn(out, (F.col("_offset") + F.col("_in_rn")).cast("bigint"))
             .drop("_chunk", "_in_rn", "_offset"))


def next_in_order(df: DataFrame, keys, order_col: str, value: str, chunk: Column | None = None,
                  out: str = "next_value") -> DataFrame:
    """Add ``out`` = ``value`` of the next row of the same key (``lead``), NULL for the last.

    ``order_col`` must be unique within a key.
    """
    keys = _cols(keys)
    d = _with_chunk(df, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order_col)
    d = d.withColumn("_in_next", F.lead(value).over(inner))
    summary = d.groupBy(*keys, "_chunk").agg(F.min_by(value, order_col).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    nxt = summary.select(*keys, "_chunk", F.lead("_first").over(across).alias("_next_chunk_first"))
    return (d.join(nxt, [*keys, "_chunk"], "left")
             .withColumn(out, F.coalesce("_in_next", "_next_chunk_first"))
             .drop("_chunk", "_in_next", "_next_chunk_first"))


def prev_in_order(df: DataFrame, keys, order_col: str, value: str, chunk: Column | None = None,
                  out: str = "prev_value") -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same key (``lag``)."""
    keys = _cols(keys)
    d = _with_chunk(df, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order_col)
    d = d.withColumn("_in_prev", F.lag(value).over(inner))
    summary = d.groupBy(*keys, "_chunk").agg(F.max_by(value, order_col).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    prv = summary.select(*keys, "_chunk", F.lag("_last").over(across).alias("_prev_chunk_last"))
    return (d.join(prv, [*keys, "_chunk"], "left")
             .withColumn(out, F.coalesce("_in_prev", "_prev_chunk_last"))
             .drop("_chunk", "_in_prev", "_prev_chunk_last"))


def global_row_number(df: DataFrame, order: Sequence[str], num_chunks: int | None = None, out: str = "position") -> DataFrame:
    """1-based position of each row in a global order, without a single-task window.

    The rows are range-partitioned on the full order (which must be unique), sorted and written once to the
    shared checkpoint folder with their range and number in it, so a retried task or a second use meets the
    same numbers; a row's position adds the counts of earlier ranges, one row each.
    """
    import uuid

    from ..session import checkpoint_root

    spark = df.sparkSession
    n = num_chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = f"{checkpoint_root(spark)}/numbered-{uuid.uuid4().hex}"
    # the low 33 bits of the generated id count the rows of a partition
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stored.join(base, "_range").withColumn(out, (F.col("_before") + F.col("_at") + 1).cast("bigint")).select(*df.columns, out)

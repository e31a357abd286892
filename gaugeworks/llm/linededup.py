"""Cross-site line dedup by distinct-site spread.

Every line (trimmed; blank lines aside) is known by a 96-bit hash. One
aggregation merges a HyperLogLog sketch of the sites it occurs on, per line,
combined before the shuffle, so a line in a third of all rows is no hot key.
Sketch estimates clear of ``min_sites`` decide; lines whose estimate lies
within ``BAND`` of it get an exact distinct count of sites. A line on at least
``min_sites`` sites is boilerplate: its first occurrence (smallest id, then
position) stays, all others are removed from their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

MIN_SITES = 10
#: Sketch size (2^12 registers: 1.6 % standard error) and the relative band that gets exact counts (3 errors).
SKETCH_BITS = 12
BAND = 0.05


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("_id", "_row", "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_line", F.trim("_line")).where("_line <> ''")
    return lines.select("_id", "_row", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.hash("_line").alias("_h2"))


def line_spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(_h1, _h2, _first)`` of the lines on at least ``min_sites`` distinct sites (null sites do not count)."""
    key = ["_h1", "_h2"]
    spread = lines.groupBy(*key).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(SKETCH_BITS))).alias("_sites"),
        F.min(F.struct("_id", "_pos")).alias("_first"))
    spread = staged(spread.where(F.col("_sites") >= int(min_sites * (1 - BAND))), "line-spread")
    sure = spread.where(F.col("_sites") > min_sites * (1 + BAND))
    near = spread.where(F.col("_sites") <= min_sites * (1 + BAND))
    exact = lines.join(broadcast_if_small(near.select(*key), 32), key, "left_semi").select(*key, "_site").distinct() \
        .groupBy(*key).agg(F.count("_site").alias("_n")).where(F.col("_n") >= min_sites)
    return sure.select(*key, "_first").unionByName(near.join(exact, key, "left_semi").select(*key, "_first"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """All rows of ``docs`` with the text less its boilerplate lines, and ``n_removed long``.

    Null texts stay null, texts whose lines all go become empty, rows are never
    dropped; rows without a removed line keep their text byte for byte. Rows with
    null id are judged like others (a null id comes first). Repeated rows (same id
    and text) lose the same lines. An existing ``n_removed`` is replaced.
    """
    docs = docs.drop("n_removed")
    base = docs.withColumn("_gw_row", F.xxhash64(id_col, text_col))
    slim = base.select(F.col(id_col).alias("_id"), F.col("_gw_row").alias("_row"), F.col(site_col).cast("string").alias("_site"),
                       F.col(text_col).alias("_text"))
    lines = _lines(slim)
    # a written table on one side: a common line is broadcast away, or split as the skewed side of a shuffled join
    spread = staged(line_spread(lines, min_sites), "line-boilerplate")
    hits = lines.join(broadcast_if_small(spread, 64), ["_h1", "_h2"]).where(~F.struct("_id", "_pos").eqNullSafe(F.col("_first")))
    gone = hits.groupBy("_row").agg(F.collect_set("_pos").alias("_gone"))
    joined = base.join(gone, base["_gw_row"] == gone["_row"], "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))

"""Physical-plan checks: pruning, pushdown, partition pruning, no Python in
SQL-expressible operators, and bounded broadcasts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans import registry
from gaugeworks.sources import tables
from gaugeworks.sources.telemetry_store import read_telemetry, time_range, write_telemetry

from conftest import SF_SMALL

registry.load_all()

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapGroupsInPandasWithState", "PythonMapInArrow")
# Operators that are Python by design (ordered folds, binary decoding, sources with a driver-side bound).
PYTHON_BY_DESIGN = {"reorder_deliver", "rate_limit", "login_limit", "storage_meter",
                    "nonce_replay", "payload_verdict", "fragment_reassembly", "frame_decode"}
SIDE_EFFECTING = {n for n in registry.QUERIES if n.startswith("stream_") and n != "stream_dedup_batch"} | {"raw_append", "aged_layout"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - PYTHON_BY_DESIGN - SIDE_EFFECTING))
def test_sql_expressible_queries_stay_in_the_jvm(spark, name):
    p = plan(registry.QUERIES[name](spark, SF_SMALL))
    assert not any(node in p for node in PYTHON_NODES), p


def test_rollup_reads_only_needed_columns(spark):
    p = plan(registry.QUERIES["usage_1h"](spark, SF_SMALL))
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "props" not in schema and "ts" in schema and "user_id" in schema


def test_range_read_prunes_partitions_and_pushes_filters(spark):
    path = tempfile.mkdtemp(prefix="gw-store-") + "/telemetry"
    tel = tables.telemetry(spark, SF_SMALL).select("time", "device_id", "metric_id", "metric_value", "region",
                                                   "ingested_at")
    write_telemetry(tel, path)
    df = time_range(read_telemetry(spark, path), "2024-01-05 00:00:00", "2024-01-07 00:00:00") \
        .where(F.col("device_id") == "dev-3")
    p = plan(df)
    assert "PartitionFilters" in p and "day" in p[p.index("PartitionFilters"):].split("]")[0]
    pushed = p[p.index("PushedFilters"):].split("]")[0]
    assert "time" in pushed and "device_id" in pushed
    expected = tel.where((F.col("time") >= F.lit("2024-01-05").cast("timestamp_ntz"))
                         & (F.col("time") < F.lit("2024-01-07").cast("timestamp_ntz"))
                         & (F.col("device_id") == "dev-3"))
    assert df.count() == expected.count()


def test_aggregations_are_partial_before_the_shuffle(spark):
    p = plan(registry.QUERIES["usage_15m"](spark, SF_SMALL))
    assert p.count("HashAggregate") >= 2 and "Exchange hashpartitioning" in p


def test_tier_versions_are_searched_without_a_join(spark):
    for name in ("tier_asof", "tier_batch_pinned"):
        assert "NestedLoopJoin" not in plan(registry.QUERIES[name](spark, SF_SMALL)), name


def test_hot_key_scan_is_chunked(spark):
    """The single ledger stream is scanned per hour, not in one window partition."""
    p = plan(registry.QUERIES["seq_gaps"](spark, SF_SMALL))
    assert "_chunk" in p


def test_no_cross_joins(spark):
    for name in sorted(set(registry.QUERIES) - SIDE_EFFECTING):
        p = plan(registry.QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name

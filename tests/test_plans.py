"""What the plans must and must not contain, and that results hold without broadcasting."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import QUERIES
from airmon.operators import quality as qc
from helpers import plan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def scans(text):
    return [x for x in text.splitlines() if "FileScan" in x]


def test_period_reaches_the_scan(spark):
    for name in ("filter_period", "filter_hour_range"):
        scan, = scans(plan(entry.queries()[name](spark, SF)))
        assert "GreaterThanOrEqual(ts" in scan and ("LessThan(ts" in scan or "LessThanOrEqual(ts" in scan)


def test_columns_are_pruned(spark):
    scan, = scans(plan(entry.queries()["hour_ending_date"](spark, SF)))
    assert scan.endswith("ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>")


def test_dedup_combines_before_it_shuffles(spark):
    text = plan(entry.queries()["dedup_site_hour"](spark, SF))
    assert "SortAggregate" not in text and "Window" not in text
    assert text.index("Exchange hashpartitioning") < text.index("partial_min_by")
    assert text.count("Exchange hashpartitioning") == 1


def test_flagship_moves_only_combined_rows(spark):
    text = plan(entry.entry(spark))
    assert text.count("Exchange hashpartitioning") == 3
    assert text.count("FileScan") == 1
    assert "SortMergeJoin" not in text and "Window" not in text and "SortAggregate" not in text


def test_windows_are_never_over_everything(spark):
    for name, q in QUERIES.items():
        lines = plan(q(spark, SF)).splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line:
                below = "\n".join(lines[i + 1:i + 4])
                assert "SinglePartition" not in below, name


@pytest.mark.parametrize("name", [
    "flag_lookup", "flux_interval_join", "trim_record", "after_last_of", "classify_onlake", "filter_sites",
    "gap_fill_from_reference", "override_direction", "sites_in_network", "priority_splice", "exceed_site_table",
])
def test_same_result_when_nothing_may_be_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, SF)
        assert oracle.compare(df, oracle.connect(SF), entry.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_large_interval_tables_are_joined_by_bucket(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["flux_interval_join"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    join, = [x for x in text.splitlines() if "SortMergeJoin" in x]
    assert "_bucket" in join and "deployment_id" in join


def test_partitioned_writes_are_rebalanced(spark):
    df = Proxy(spark, SF).hours.hint("rebalance", "date")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(df)


def test_hot_site_does_not_travel_whole(spark):
    """A third of all rows fall on one site-hour; what is shuffled is one row per key and map task."""
    from pyspark.sql import functions as F

    n = 300_000
    df = spark.range(0, n, 1, 8).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "KE").otherwise("OL").alias("abrv"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 200).cast("int")))).alias("datetime"),
        F.col("id").cast("double").alias("pm10"))
    out = qc.dedup_site_hour(df, ["event_id"])
    assert out.agg(F.min("event_id")).first()[0] == 0
    out = qc.dedup_site_hour(df, ["event_id"])
    rows = out.collect()
    assert len(rows) == df.select("abrv", "datetime").distinct().count()
    stage = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in stage

"""Plans are what a large cluster needs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hookloom.operators import catalog as cat
from hookloom.operators import dedupe as dd
from hookloom.operators import normalize as nm
from hookloom.operators import readback as rb
from hookloom.session import spread_scan, stage_table
from tests.helpers import request, requests_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def requests(spark):
    return requests_table(spark, request("sendgrid", {"sg_event_id": "1"}), request("github", {}))


def test_bodies_are_parsed_once_and_nothing_is_shuffled(requests, lookup):
    events = nm.normalize_requests(requests, lookup)
    for df in (events, events.filter("type = 'x'"), events.groupBy("type").count(), nm.classify_requests(requests, lookup)):
        assert plan(df).count("parseJson") == 1
    assert "BroadcastHashJoin" in plan(events) and "Exchange hash" not in plan(events)


def test_large_catalog_is_not_broadcast(spark, requests, catalog):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(nm.normalize_requests(requests, cat.compile_lookup(catalog, max_bytes=10)))
        assert "SortMergeJoin" in text and "Broadcast" not in text.split("SortMergeJoin")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unused_fields_are_not_extracted(requests, lookup):
    text = plan(nm.normalize_requests(requests, lookup).select("id", "type"))
    assert "bounce_classification" not in text


def test_trimming_filters_rows_where_they_are(spark):
    """Cutoffs are found first, so that rows are neither ranked nor shuffled."""
    events = spark.range(10).select(
        F.col("id").cast("string"), F.lit("s").alias("source"), F.timestamp_seconds("id").alias("stored_at"))
    text = plan(rb.trim_events(events, 3))
    assert "Window" not in text and "CartesianProduct" not in text and "hashpartitioning" not in text
    whole = plan(rb.trim_table(events, 3, "stored_at", "id"))
    assert "Join" not in whole and "CartesianProduct" not in whole and "Exchange" not in whole
    assert "TakeOrderedAndProject" in plan(rb.latest_events(events, "s", 3))


def test_scans_read_only_needed_columns(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        "*", F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("at"))
    text = plan(dd.ttl_duplicates(events, keys=["event_type", "user_id"], time="at"))
    assert "props" not in text and "value" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_request_sets_start_no_job(spark):
    from hookloom.plans import request_sets as rs

    sf = "/root/testdata/sf0.001"
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("request-sets", "building")
    try:
        rs.shop_requests(spark, sf, line_items=True)
        jobs = len(tracker.getJobIdsForGroup("request-sets"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3  # one for the schema of each file


def test_scans_are_spread_by_size(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 2000 * cores, 1, cores).write.parquet(f"{tmp_path}/rows")
    scan = spark.read.parquet(f"{tmp_path}/rows")
    held = sum(file.stat().st_size for file in (tmp_path / "rows").glob("*.parquet"))
    assert spread_scan(scan, size=held).rdd.getNumPartitions() == cores
    spread = spread_scan(scan, size=held // (4 * cores) + 1)
    sizes = [row["n"] for row in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 * cores and max(sizes) < 700 and sum(sizes) == scan.distinct().count() == 2000 * cores


def test_failures_of_events_are_worked_out_once(spark, monkeypatch):
    staged = {}

    def stage(df, name, path=None):
        staged[name] = stage_table(df, name, path)
        return staged[name]

    monkeypatch.setattr(entry, "stage_table", stage)
    sf = "/root/testdata/sf0.001"
    assert entry.core_queries()["reprocess_shop"](spark, sf).count() == staged["failed-events"].count()
    assert {"message_id", "payload", "headers"} <= set(staged["failed-events"].columns)
    assert "failures" in staged

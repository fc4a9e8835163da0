"""Stored events: lookup, listing, trimming, counters and retry plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hookloom.operators import metrics as mt
from hookloom.operators import readback as rb
from hookloom.operators import retries as rt
from hookloom.sources import sinks
from hookloom.sources.requests import read_requests
from tests.helpers import instant, request, requests_table, utc

EVENTS = "id string, source string, type string, external_id string, seconds long, request_id string"


def stored(spark, rows):
    df = spark.createDataFrame([(i, s, "t", f"x{i}", t, f"r{n}") for n, (i, s, t) in enumerate(rows)], EVENTS)
    when = F.timestamp_seconds("seconds")
    return df.withColumn("timestamp", when).withColumn("stored_at", when)


def test_lookup_by_id(spark):
    events = stored(spark, [("a", "s", 1), ("a", "s", 3), ("a", "s", 2), ("b", "s", 1)])
    ids = spark.createDataFrame([("a",), ("z",), ("a",)], "id string")
    got = {r.id: r.seconds for r in rb.event_by_id(events, ids).collect()}
    assert got == {"a": 3, "z": None}


def test_latest_events_newest_first(spark):
    events = stored(spark, [("a", "s", 1), ("b", "s", 2), ("c", "s", 3), ("d", "other", 9)])
    assert [r.id for r in rb.latest_events(events, "s", 2).collect()] == ["c", "b"]
    assert [r.id for r in rb.latest_events(events, "s", 2, newest_first=False).collect()] == ["b", "c"]
    listing = rb.replay_listing(events, "s").collect()
    assert listing[0]["timestamp"] == "1970-01-01T00:00:03Z" and len(listing) == 3


@pytest.mark.parametrize("n", [1, 7, 50, 400, 5000])
def test_trim_keeps_exactly_the_newest(spark, n):
    rng = random.Random(n)
    rows = [(f"e{i:04d}", rng.choice(["hot", "hot", "cold", "rare"]), rng.randrange(20) * 1800) for i in range(1200)]
    rows += [(f"burst{i:04d}", "hot", 99_999) for i in range(300)]
    got = {r.id for r in rb.trim_events(stored(spark, rows), n).collect()}
    want = set()
    for source in ("hot", "cold", "rare"):
        ranked = sorted(((t, i) for i, s, t in rows if s == source), reverse=True)
        want |= {i for _, i in ranked[:n]}
    assert got == want
    whole = {r.id for r in rb.trim_table(stored(spark, rows), n, "stored_at", "id").collect()}
    assert whole == {i for _, i in sorted(((t, i) for i, _, t in rows), reverse=True)[:n]}


def test_corrupt_entries_are_skipped_and_counted(spark):
    rows = [("s", '{"id":"1"}'), ("s", "broken"), ("s", None), ("s", '{"id":"2"} x'), ("t", "{}")]
    entries = spark.createDataFrame(rows, "source string, event string")
    assert rb.parse_stored(entries).count() == 2
    counts = {r.source: (r.readable, r.skipped) for r in rb.corrupt_counts(entries).collect()}
    assert counts == {"s": (1, 3), "t": (1, 0)}


def test_backlog(spark):
    events = stored(spark, [("a", "s", 1), ("b", "s", 2), ("c", "s", 3)])
    left = rb.backlog(events, events.filter("id = 'a'"), events.filter("id = 'b'"))
    assert [r.id for r in left.collect()] == ["c"]


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "events")
    events = stored(spark, [("a", "s", 1), ("b", "2024", 2)])
    sinks.write_events(events, path, batch_id=0)
    sinks.write_events(events.limit(1), path, batch_id=1, compact=True)
    # The same batch again replaces itself.
    sinks.write_events(events.filter("id = 'b'"), path, batch_id=1)
    table = sinks.read_table(spark, path)
    assert sorted(r.id for r in table.collect()) == ["a", "b", "b"]
    assert dict(table.dtypes)["source"] == "string"
    plan = rb.latest_events(table, "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PartitionFilters: [isnotnull(cast(source" in plan or "PartitionFilters: [isnotnull(source" in plan


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_requests_on_disk(spark, tmp_path, fmt):
    table = requests_table(spark, request("s", b"\x00\xffbody", {"H": "v"}, "1"))
    table.write.format(fmt).save(str(tmp_path / "requests"))
    assert read_requests(spark, str(tmp_path / "requests"), fmt).collect() == table.collect()


def failures(spark, rows):
    df = spark.createDataFrame(rows, "failure_id string, message_id string, hours double, error string, payload string")
    return df.withColumn("failed_at", F.timestamp_millis((F.col("hours") * 3_600_000).cast("long"))).withColumn(
        "source", F.lit("s"))


def test_retry_plan(spark):
    rows = [(f"{m}{i}", m, i / 60, f"e{i}", '{"source":"x","version":"1","raw":{"a":1}}')
            for m, n in (("one", 1), ("four", 4), ("five", 5), ("six", 6)) for i in range(n)]
    attempts = rt.attempt_counts(failures(spark, rows))
    plan = {r.message_id: r for r in rt.plan_retries(attempts).collect()}
    assert {m: (r.attempts, r.action, r.delay_seconds) for m, r in plan.items()} == {
        "one": (1, "retry", 2.0), "four": (4, "retry", 16.0),
        "five": (5, "dead_letter", None), "six": (6, "dead_letter", None)}
    assert instant(plan["four"].due_at) == utc(1970, 1, 1, 0, 3, 16)
    other = {r.message_id: r.delay_seconds for r in rt.plan_retries(attempts, 0, 0.5, first_delay_doubled=False).collect()}
    assert other == {"one": 0.5, "four": 4.0, "five": None, "six": None}
    retried = mt.metric_retried(rt.plan_retries(attempts)).collect()
    assert [tuple(r) for r in retried] == [("s", 1 + 4 + 4 + 5)]
    dead = rt.route_dead_letters(rt.plan_retries(attempts))
    assert {(r.message_id, r.reason, r.readable) for r in dead.collect()} == {("five", "e4", True), ("six", "e5", True)}
    back = rt.dead_letters_as_requests(rt.events_from_payload(dead)).collect()
    assert {(r.source, r.query_version, bytes(r.body)) for r in back} == {("x", "1", b'{"a":1}')}


def test_attempt_counter_expires(spark):
    rows = [(str(i), "m", h, "e", None) for i, h in enumerate([0.0, 5.0, 23.9, 24.0, 30.0, 47.9])]
    assert rt.attempt_counts(failures(spark, rows)).first()["attempts"] == 3
    assert rt.attempt_counts(failures(spark, rows + [("x", "m", 48.0, "e", None)])).first()["attempts"] == 1


def test_counters(spark):
    rows = [("s", "t", "accepted"), ("s", "t", "duplicate"), ("s", None, "invalid_json"),
            ("u", None, "invalid_signature"), ("u", "t", "accepted"), ("u", "v", "accepted")]
    outcomes = spark.createDataFrame(rows, "source string, type string, outcome string").withColumn(
        "received_at", F.timestamp_seconds(F.lit(3700)))
    got = {r.source: tuple(r)[1:] for r in mt.outcome_metrics(outcomes).collect()}
    assert got == {"s": (3, 1, 1, 0, 1), "u": (3, 2, 0, 1, 1)}
    assert {tuple(r) for r in mt.metric_events_ingested(outcomes).collect()} == {("s", "t", 1), ("u", "t", 1), ("u", "v", 1)}
    windows = mt.ingest_metrics(outcomes).collect()
    assert {instant(r.window_start) for r in windows} == {utc(1970, 1, 1, 1)} and len(windows) == 5


def test_latency_histogram_is_cumulative(spark):
    rows = spark.createDataFrame(
        [("s", 202, x) for x in (0.004, 0.005, 0.3, 2.5, 99.0)], "source string, status int, latency_seconds double")
    got = {r.le: r.requests for r in mt.latency_histogram(rows).collect()}
    assert got == {"0.005": 2, "0.01": 2, "0.025": 2, "0.05": 2, "0.1": 2, "0.25": 2, "0.5": 3, "1.0": 3,
                   "2.5": 4, "5.0": 4, "10.0": 4, "+Inf": 5}


def test_trim_treats_null_as_a_group_and_ranks_one_instant(spark):
    from datetime import timedelta

    from hookloom.operators import readback as rb
    from tests.helpers import ARRIVAL

    rows = [(f"{i:03d}", None if i % 2 else "a", ARRIVAL + timedelta(microseconds=i // 8)) for i in range(200)]
    table = spark.createDataFrame(rows, "id string, source string, stored_at timestamp")
    kept = rb.trim_events(table, 7).collect()
    newest = lambda odd: sorted(r[0] for r in rows if (r[1] is None) == odd)[-7:]
    assert sorted(r.id for r in kept if r.source is None) == newest(True)
    assert sorted(r.id for r in kept if r.source == "a") == newest(False)
    assert sorted(r.id for r in rb.trim_table(table, 11, "stored_at", "id").collect()) == [f"{i:03d}" for i in range(189, 200)]


def test_numeric_looking_sources_come_back_as_written(spark, tmp_path):
    from hookloom.sources import sinks

    table = spark.createDataFrame([("a", "007"), ("b", "7"), ("c", "1e3")], "id string, source string")
    sinks.write_events(table, str(tmp_path / "events"), batch_id=3)
    back = sinks.read_table(spark, str(tmp_path / "events"))
    assert sorted((r.id, r.source) for r in back.collect()) == [("a", "007"), ("b", "7"), ("c", "1e3")]
    assert dict(back.dtypes)["batch_id"] == "bigint"


def scanned_rows(df):
    """Rows that the files gave, after row groups were ruled out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_lookup_by_id_reads_few_row_groups(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "events")
    ids = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60_000)]
    rows = spark.createDataFrame([(i, "s", f"r{n}") for n, i in enumerate(ids)], "id string, source string, request_id string")
    sinks.write_events(rows.repartition(60), path)
    table = sinks.read_table(spark, path)
    wanted = [*ids[::6000], "unknown"]
    found = rb.rows_with_ids(table, wanted)
    assert sorted(r.id for r in found.collect()) == sorted(ids[::6000])
    # Ten ids lie in ten of sixty files at most; the filters of the others rule them out.
    assert scanned_rows(found) <= 15 * 1000 < table.count() / 3
    asked = spark.createDataFrame([(i,) for i in [*wanted, wanted[0], None]], "id string")
    got = {r.id: r.request_id for r in rb.event_by_id(table, asked).collect()}
    assert got == {**{ids[n]: f"r{n}" for n in range(0, 60_000, 6000)}, "unknown": None, None: None}
    many = spark.createDataFrame([(i,) for i in ids[:200]], "id string")
    assert rb.event_by_id(table, many).filter("request_id IS NOT NULL").count() == 200


def test_trim_scans_the_table_twice_to_find_the_cutoff_and_once_to_filter(spark, tmp_path):
    import random

    draw = random.Random(1)
    rows = [(f"{i:05d}", draw.choice("abc"), draw.randrange(10**6)) for i in range(30_000)]
    rows += [(f"x{i:05d}", "tied", 5) for i in range(5000)] + [("old", "a", None), ("few", "d", 1)]
    table = spark.createDataFrame(rows, "id string, source string, n long").withColumn("stored_at", F.timestamp_micros("n"))
    table.write.parquet(str(tmp_path / "t"))
    stored_table = spark.read.parquet(str(tmp_path / "t"))
    for n in (1, 100, 4999, 5000, 9000):
        want = set()
        for source in ("a", "b", "c", "tied", "d"):
            own = [(n_, i) for i, s, n_ in rows if s == source]
            want |= {i for _, i in sorted(own, key=lambda r: (-1 if r[0] is None else r[0], r[1]))[-n:]}
        kept = rb.trim_events(stored_table, n)
        assert {r.id for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3
    kept = rb.trim_table(stored_table, 777, "stored_at", "id")
    ordered = sorted(((-1 if n_ is None else n_, i) for i, _, n_ in rows))[-777:]
    assert {r.id for r in kept.collect()} == {i for _, i in ordered}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    assert rb.trim_table(stored_table.limit(0), 5, "stored_at", "id").count() == 0
    assert rb.trim_events(stored_table, 10**6).count() == len(rows)


def test_a_sketch_that_misses_is_made_good(spark):
    """With a tiny sketch brackets are wide or wrong; results are the same."""
    rows = [(f"{i:05d}", "s" if i % 3 else None, (i * 7919) % 10007) for i in range(10_000)]
    table = spark.createDataFrame(rows, "id string, source string, n long").withColumn("stored_at", F.timestamp_micros("n"))
    brackets = spark.createDataFrame([("s", 10, 20), (None, 10_006, 20_000)], "source string, low long, high long")
    slim = table.select("source", F.unix_micros("stored_at").alias("us"), "id")
    assert rb._ranked_cutoffs(slim, brackets, 100, ["source"]).count() == 0
    kept = rb.newest_per_group(table, 100, sketch_size=8).collect()
    for source in ("s", None):
        own = sorted((n, i) for i, s, n in rows if s == source)[-100:]
        assert sorted(r.id for r in kept if r.source == source) == sorted(i for _, i in own)


def test_latency_quantiles_of_merged_sketches(spark):
    rows = spark.createDataFrame([("s", 202, i % 24, i / 1000) for i in range(20_000)], "source string, status int, hour int, latency_seconds double")
    by = ["source", "status"]
    merged = mt.merge_sketches(mt.latency_sketches(rows, [*by, "hour"]), by)
    got = {r.quantile: r.seconds for r in mt.latency_quantiles(merged, by).collect()}
    assert all(abs(got[q] - q * 20) < 0.2 for q in (0.5, 0.95, 0.99)) and merged.first()["requests"] == 20_000


def test_store_latencies(spark):
    outcomes = spark.createDataFrame(
        [("e1", "s", 202, "accepted", 10), ("e2", "s", 202, "accepted", 20), ("e3", "s", 200, "duplicate", 30), (None, "s", 400, "invalid_json", 5)],
        "event_id string, source string, status int, outcome string, n long").withColumn("received_at", F.timestamp_seconds("n"))
    events = spark.createDataFrame([("e1", 10_250), ("e1", 99_000), ("e3", 31_000)], "id string, ms long").withColumn(
        "stored_at", F.timestamp_millis("ms"))
    got = mt.store_latencies(outcomes, events).collect()
    assert [(r.event_id, r.status, r.latency_seconds) for r in got] == [("e1", 202, 0.25)]

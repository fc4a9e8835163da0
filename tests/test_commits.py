"""Batches that are seen whole or not at all, and claims that stay few files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hookloom.operators.dedupe import drop_already_seen
from hookloom.schemas import REQUESTS
from hookloom.sources import commits, landing, retention, sinks
from hookloom.sources.claims import ClaimStore
from hookloom.sources.requests import stream_requests
from hookloom.sources.sinks import read_table, stage_requests
from hookloom.streaming import dedupe as sd
from hookloom.streaming import ingest as si
from tests.helpers import request, requests_table, utc


def rows(spark, *ids):
    return spark.createDataFrame([(i, "s") for i in ids], "id string, source string")


def ids(table):
    return sorted(r.id for r in table.collect())


def write_two(spark, base, batch_id, *names, fail=False):
    def write(attempt):
        sinks.write_events(rows(spark, *names), f"{base}/events", batch_id, attempt=attempt)
        if fail:
            raise RuntimeError("crash between sinks")
        sinks.write_outcomes(rows(spark, *names), f"{base}/outcomes", batch_id, attempt)
        return dict.fromkeys(("events", "outcomes"))

    return commits.write_batch(spark, base, batch_id, write)


def test_a_crash_between_sinks_shows_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    assert write_two(spark, base, 0, "a", "b")
    with pytest.raises(RuntimeError):
        write_two(spark, base, 1, "c", fail=True)
    for table in ("events", "outcomes"):
        assert ids(read_table(spark, f"{base}/{table}")) == ["a", "b"]
    # Run again, the batch shows once, without what the failed attempt left.
    assert write_two(spark, base, 1, "c")
    assert not write_two(spark, base, 1, "c")
    for table in ("events", "outcomes"):
        found = read_table(spark, f"{base}/{table}")
        assert ids(found) == ["a", "b", "c"] and "attempt" not in found.columns
    assert [p for p in os.listdir(f"{base}/events/batch_id=1") if p.startswith("attempt=")].__len__() == 2


def test_a_store_without_commits_is_read_as_it_is(spark, tmp_path):
    sinks.write_events(rows(spark, "a"), str(tmp_path / "events"), 0)
    assert commits.manifests(spark, str(tmp_path)) is None and commits.committed_place(spark, str(tmp_path), "events") is None
    assert ids(read_table(spark, str(tmp_path / "events"))) == ["a"]


def claim_rows(spark, *pairs):
    table = spark.createDataFrame([("s", *pair) for pair in pairs], "source string, external_id string, seconds long")
    return table.select("source", "external_id", F.timestamp_seconds("seconds").alias("received_at"))


def files_below(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_claims_stay_few_files_and_expire(spark, tmp_path):
    base = str(tmp_path / "store")
    for batch in range(25):
        store = ClaimStore(spark, base, keep_seconds=1000, buckets=4, batches=5)
        added = claim_rows(spark, *((f"k{batch}-{i}", batch * 100 + i) for i in range(10)), ("always", batch * 100), ("", 1))
        commits.write_batch(spark, base, batch, lambda attempt: {"claims": store.add(added, batch, attempt)})
        assert len(files_below(f"{base}/claims")) <= 2 * 4 * 5
    history = ClaimStore(spark, base, 1000, 4, 5).history()
    latest = {r.external_id: r.n for r in history.groupBy("external_id").agg(F.max(F.unix_micros("received_at")).alias("n")).collect()}
    assert latest["always"] == 2400 * 10**6 and "k24-9" in latest and "k15-0" in latest and "" not in latest
    assert not any(key.startswith("k0-") for key in latest)


def test_an_attempt_that_failed_claims_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    store = ClaimStore(spark, base, 1000, buckets=2)
    commits.write_batch(spark, base, 0, lambda attempt: {"claims": store.add(claim_rows(spark, ("a", 1)), 0, attempt)})

    def crash(attempt):
        store.add(claim_rows(spark, ("b", 2)), 1, attempt)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        commits.write_batch(spark, base, 1, crash)
    assert [r.external_id for r in store.history().collect()] == ["a"]
    # Another number of buckets writes the claims anew.
    other = ClaimStore(spark, base, 1000, buckets=3)
    commits.write_batch(spark, base, 1, lambda attempt: {"claims": other.add(claim_rows(spark, ("c", 3)), 1, attempt)})
    assert sorted(r.external_id for r in other.history().collect()) == ["a", "c"]


def test_claims_are_joined_where_they_lie(spark, tmp_path):
    base = str(tmp_path / "store")
    store = ClaimStore(spark, base, 1000, buckets=8)
    commits.write_batch(spark, base, 0, lambda attempt: {
        "claims": store.add(claim_rows(spark, *((f"k{i}", i) for i in range(500))), 0, attempt)})
    batch = claim_rows(spark, *((f"k{i}", 900) for i in range(400, 600)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = drop_already_seen(batch, store.history(), ttl_seconds=600)
        assert fresh.count() == 200 - 100
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows of the batch are dealt to the buckets; claims are read as they lie.
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line and "external_id" in line]
    assert len(dealt) == 1 and "Bucketed: true" in plan


def mail(i, key, received_at):
    return request("sendgrid", {"sg_event_id": key, "event": "open", "timestamp": 1720000000 + i}, received_at=received_at)


def test_requests_without_an_arrival_do_not_stop_the_stream(spark, lookup, tmp_path):
    sd.stream_settings(spark, bounded=True)
    landing, out = str(tmp_path / "requests"), str(tmp_path / "tables")
    batches = [
        [mail(0, "a", utc(2024, 8, 1, 12, 0)), mail(1, "n", None), mail(2, "n", None)],
        [mail(3, "a", utc(2024, 8, 1, 12, 5)), mail(4, "n", None), mail(5, "b", utc(1970, 1, 1, 0, 0))],
        [mail(6, "a", utc(2024, 8, 3, 12, 0)), mail(7, "b", utc(2024, 8, 3, 12, 0)), mail(8, "n", utc(2024, 8, 3, 12, 0))],
    ]
    outcomes = []
    for number, batch in enumerate(batches):
        table = requests_table(spark, *batch).withColumn("request_id", F.concat(F.lit(f"{number}-"), "request_id"))
        stage_requests(spark.createDataFrame(table.collect(), REQUESTS).coalesce(1), landing)
        si.ingest_batches(stream_requests(spark, landing), lookup, out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        found = read_table(spark, f"{out}/outcomes")
        outcomes.append(sorted((r.request_id, r.outcome) for r in found.filter(F.col("batch_id") == number).collect()))
    assert [[o for _, o in batch] for batch in outcomes] == [
        ["accepted"] * 3, ["duplicate", "accepted", "accepted"], ["accepted"] * 3]


def test_retention_drops_old_batches_and_rewrites_those_at_the_edge(spark, tmp_path):
    base = str(tmp_path / "store")
    everything = []
    for batch in range(6):
        made = [(f"{batch}{i:03d}", "fast", batch * 100 + i) for i in range(50)] + [(f"{batch}x", "slow", batch * 100)]
        # The second batch holds fast rows alone.
        made = made[:50] if batch == 1 else made
        everything += made
        table = spark.createDataFrame(made, "id string, source string, n long").withColumn("stored_at", F.timestamp_seconds("n"))

        def write(attempt):
            sinks.write_events(table, f"{base}/events", batch, attempt=attempt)
            sinks.write_outcomes(table, f"{base}/outcomes", batch, attempt)
            return dict.fromkeys(("events", "outcomes"))

        commits.write_batch(spark, base, batch, write)
    done = retention.retain_newest(spark, base, n=120)
    assert done == retention.Retained(untouched=[4, 5], rewritten=[0, 2, 3], dropped=[1])
    want = sorted(i for i, s, _ in everything if s == "slow") + sorted(i for i, s, _ in everything if s == "fast")[-120:]
    found = read_table(spark, f"{base}/events")
    assert ids(found) == sorted(want)
    # Other tables of a batch stay as they were, and nothing is left to do.
    assert read_table(spark, f"{base}/outcomes").count() == len(everything)
    assert retention.retain_newest(spark, base, n=120) == retention.Retained([0, 2, 3, 4, 5], [], [])
    before = len(files_below(f"{base}/events"))
    assert retention.vacuum(spark, base) == 4 and retention.vacuum(spark, base) == 0
    assert ids(read_table(spark, f"{base}/events")) == sorted(want)
    assert before >= len(files_below(f"{base}/events"))
    # A batch that was dropped is not written again.
    assert not commits.write_batch(spark, base, 1, lambda attempt: {"events": None})


def test_landed_batches_are_ingested_once_across_restarts(spark, lookup, tmp_path):
    sd.stream_settings(spark, bounded=True)
    base, out, checkpoint = (str(tmp_path / name) for name in ("landing", "tables", "checkpoint"))

    def land(batch, *keys):
        table = requests_table(spark, *(mail(i, key, utc(2024, 8, 1, batch, i)) for i, key in enumerate(keys)))
        return landing.land_requests(table.withColumn("request_id", F.concat(F.lit(f"{batch}-"), "request_id")).repartition(3), base, batch)

    def run(**options):
        si.ingest_landings(spark, base, lookup, out, checkpoint, max_batches=2, once=True, **options).awaitTermination()
        found = read_table(spark, f"{out}/outcomes")
        return sorted((r.request_id, r.outcome, r.batch_id) for r in found.select("request_id", "outcome", "batch_id").collect())

    for batch in range(3):
        assert land(batch, "a", f"b{batch}")
    assert not land(2, "x")
    # A batch that is being landed: files, but no manifest.
    sinks.stage_requests(requests_table(spark, mail(0, "half", utc(2024, 8, 1, 20))), f"{base}/requests", 9, "unfinished")
    first = run()
    assert [o for _, o, _ in first] == ["accepted", "accepted", "duplicate", "accepted", "duplicate", "accepted"]
    # Two landed batches at most in one micro-batch.
    assert [b for _, _, b in first] == [0, 0, 0, 0, 1, 1]
    assert run() == first
    land(3, "a", "c")
    second = run(clear=True)
    assert second[:6] == first and [o for _, o, _ in second[6:]] == ["duplicate", "accepted"]
    assert spark.read.schema(REQUESTS).parquet(f"{base}/requests/batch_id=3").count() == 0
    assert run() == second


def test_a_spread_write_sorts_in_tasks_of_bounded_size(spark, tmp_path):
    one_task = spark.range(200_000).coalesce(1).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("s").alias("source"))
    sinks.write_events(one_task, f"{tmp_path}/events", spread=True)
    stored = read_table(spark, f"{tmp_path}/events")
    per_file = [row["n"] for row in stored.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per_file) > 1 and sum(per_file) == 200_000 and max(per_file) < 120_000
    assert stored.distinct().count() == 200_000

"""Streams against the batch operators."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookloom.operators import readback as rb
from hookloom.operators.metrics import ingest_metrics
from hookloom.plans.ingest import ingest
from hookloom.schemas import REQUESTS
from hookloom.sources.requests import stream_requests
from hookloom.sources.sinks import read_table, stage_requests
from hookloom.streaming import dedupe as sd
from hookloom.streaming import ingest as si
from hookloom.streaming import retries as sr
from tests.helpers import request, requests_table, utc


@pytest.fixture(autouse=True)
def bounded(spark):
    sd.stream_settings(spark, bounded=True)


def collected(stream, tmp_path, name="out", mode="append"):
    out, checkpoint = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def mail(i, key, minute):
    body = {"sg_event_id": key, "event": "open", "timestamp": 1720000000 + i}
    return request("sendgrid", body, received_at=utc(2024, 8, 1, 12, minute))


BATCHES = [
    [mail(0, "a", 0), mail(1, "a", 1), mail(2, "b", 2), mail(3, "", 3), request("sendgrid", "broken"),
     request("", "{}")],
    [mail(4, "a", 10), mail(5, "c", 11), mail(6, "", 12), request("github", {"ref": "x"}, {"X-GitHub-Event": "push"}),
     request("sendgrid", {"sg_event_id": "d", "timestamp": 10**18})],
]


@pytest.fixture
def landed(spark, tmp_path):
    """Two files, one per micro-batch."""
    path = str(tmp_path / "requests")
    rows = [r for batch in BATCHES for r in batch]
    table = requests_table(spark, *rows)
    first = F.col("request_id") < f"r{len(BATCHES[0]):04d}"
    for part in (table.filter(first), table.filter(~first)):
        stage_requests(part.coalesce(1), path)
        time.sleep(1.1)  # files are taken in order of their time
    return path


def event_rows(events):
    rows = events.select(
        "id", "external_id", "type", "timestamp", "received_at",
        F.to_json("data").alias("data"), F.to_json("raw").alias("raw"),
    ).collect()
    return sorted(str({**r.asDict(), "data": sorted(json.loads(r.data).items(), key=str)}) for r in rows)


@pytest.mark.parametrize("start", [si.ingest_batches, si.ingest_stateful])
def test_stream_equals_batch(spark, lookup, landed, tmp_path, start):
    stream = stream_requests(spark, landed, max_files=1)
    out = str(tmp_path / "tables")
    start(stream, lookup, out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    batch = ingest(spark.read.schema(REQUESTS).parquet(landed), lookup)
    columns = ["request_id", "source", "version", "type", "outcome", "status", "event_id"]
    got = read_table(spark, f"{out}/outcomes").select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.outcomes.fillna("", ["source"]).select(*columns).collect()))
    events = read_table(spark, f"{out}/events")
    assert event_rows(events) == event_rows(batch.events)
    # With state, the files of classified requests are a stream of their own, here taken at once.
    batches = {0, 1} if start is si.ingest_batches else {0}
    assert {r.batch_id for r in events.select("batch_id").distinct().collect()} == batches
    assert [r.external_id for r in read_table(spark, f"{out}/dead_letters").collect()] == ["d"]


def test_claims_expire_on_the_processing_clock(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    schema = "source string, external_id string, request_id string, received_at timestamp"
    row = spark.createDataFrame([("s", "k", "1")], "source string, external_id string, request_id string")
    accepted = []
    for wait in (0, 0, 12):
        time.sleep(wait)
        row.withColumn("received_at", F.current_timestamp()).write.mode("append").parquet(source)
        stream = sd.accepted_claims(spark.readStream.schema(schema).parquet(source), ttl_seconds=10)
        rows = collected(stream, tmp_path)
        accepted.append(rows.filter("row_id IS NOT NULL").count())
    # New, then a repeat that does not extend the claim, then a claim anew.
    assert accepted[-1] == 2 and accepted[0] == 1
    assert out.exists()


def test_whole_rows_are_marked_and_the_state_sees_keys_alone(spark, tmp_path):
    """Payloads of any type come through, from folders with blanks; only keys, time and id enter the state."""
    path = str(tmp_path / "in coming")
    schema = T.StructType.fromDDL(
        "source string, external_id string, request_id string, received_at timestamp, payload variant, tags map<string,string>")
    rows = [("s", "a", "1", 10), ("s", "a", "2", 5), ("s", "b", "3", 7), ("s", "", "4", 1), (None, "a", "5", 2), ("t", "a", "6", 3)]
    seen = {}

    def write(batch, batch_id):
        for row in batch.withColumn("payload", F.to_json("payload")).collect():
            seen[row.request_id] = (row.accepted, row.payload, row.tags, batch_id)

    for part in (rows, [("s", "a", "7", 20), ("s", "c", "8", 21), ("s", "c", "9", 21)]):
        table = spark.createDataFrame(part, "source string, external_id string, request_id string, n long")
        table.select(
            "source", "external_id", "request_id", F.timestamp_seconds("n").alias("received_at"),
            F.parse_json(F.concat(F.lit('{"n":'), "n", F.lit("}"))).alias("payload"),
            F.create_map(F.lit("k"), F.col("request_id")).alias("tags"),
        ).write.mode("append").parquet(path)
        query = sd.dedupe_files(spark, path, schema, write, str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination()
        plan = query._jsq.explainInternal(True)
    assert {key: value[0] for key, value in seen.items()} == {
        "1": False, "2": True, "3": True, "4": True, "5": True, "6": True, "7": False, "8": True, "9": False}
    assert seen["2"][1:] == ('{"n":5}', {"k": "2"}, 0) and seen["7"][3] == 1
    physical = plan.split("== Physical Plan ==")[1]
    assert "TransformWithState" in physical and "payload" not in physical and "tags" not in physical


def _redeliveries(spark, tmp_path, base_seconds):
    stream = spark.readStream.schema(FAILED).parquet(str(tmp_path / "in"))
    return collected(sr.redelivery_stream(stream, max_retries=3, base_seconds=base_seconds), tmp_path)


FAILED = "message_id string, source string, error string, failed_at timestamp, payload string"


def test_failures_come_back_when_due(spark, tmp_path):
    def land(*ids):
        spark.createDataFrame([(i, "s", "e", f"p-{i}") for i in ids], "message_id string, source string, error string, payload string") \
            .withColumn("failed_at", F.current_timestamp()).select(*FAILED_NAMES).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))

    land("m", "m", "n", "old")
    first = time.time()
    got = _redeliveries(spark, tmp_path, base_seconds=6.0)
    # Due in 12 and 24 seconds: nothing comes out before.
    assert got.count() == 0 and time.time() - first < 12
    time.sleep(max(0.0, first + 13.5 - time.time()))
    land("k")
    got = _redeliveries(spark, tmp_path, base_seconds=6.0)
    if time.time() < first + 23:
        assert sorted((r.message_id, r.attempt, r.action, r.payload) for r in got.collect()) == [
            ("m", 1, "redeliver", "p-m"), ("n", 1, "redeliver", "p-n"), ("old", 1, "redeliver", "p-old")]
    time.sleep(max(0.0, first + 25.5 - time.time()))
    land("m")  # the third failure of m is its last
    got = _redeliveries(spark, tmp_path, base_seconds=6.0).filter("message_id <> 'k'")
    assert sorted((r.message_id, r.attempt, r.action) for r in got.collect()) == [
        ("m", 1, "redeliver"), ("m", 2, "redeliver"), ("m", 3, "dead_letter"), ("n", 1, "redeliver"), ("old", 1, "redeliver")]
    assert got.filter("action = 'redeliver' AND due_at < failed_at + INTERVAL 12 SECONDS").count() == 0
    time.sleep(max(0.0, first + 40 - time.time()))
    land("z")
    _redeliveries(spark, tmp_path, base_seconds=6.0)
    left = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "out-checkpoint"))
    assert {r.key.message_id for r in left.select("key").collect()} <= {"z"}


FAILED_NAMES = ["message_id", "source", "error", "failed_at", "payload"]


def test_overdue_failures_come_at_once_with_nulls(spark, tmp_path):
    rows = [("m", "s", None, 10, None), ("m", None, "e", 20, "x"), (None, "s", "e", 5, "y")]
    spark.createDataFrame(rows, "message_id string, source string, error string, n long, payload string").select(
        "message_id", "source", "error", F.timestamp_seconds("n").alias("failed_at"), "payload").write.parquet(str(tmp_path / "in"))
    got = _redeliveries(spark, tmp_path, base_seconds=1.0).collect()
    assert sorted(((r.message_id, r.attempt, r.action, r.payload) for r in got), key=str) == [
        (None, 1, "redeliver", "y"), ("m", 1, "redeliver", None), ("m", 2, "redeliver", "x")] or len(got) == 3


def test_watermark_variant(spark, tmp_path):
    rows = [("s", k, i) for i, k in enumerate(["a", "a", "b"])]
    df = spark.createDataFrame(rows, "source string, external_id string, n long")
    df.withColumn("received_at", F.timestamp_seconds("n")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, external_id string, n long, received_at timestamp").parquet(
        str(tmp_path / "in"))
    assert sorted(r.external_id for r in collected(sd.dedupe_watermark(stream), tmp_path).collect()) == ["a", "b"]


def test_retry_decisions(spark, tmp_path):
    rows = [("m", "s", f"e{i}", i) for i in range(7)] + [("n", "s", "x", 0)]
    df = spark.createDataFrame(rows, "message_id string, source string, error string, n long")
    df.withColumn("failed_at", F.timestamp_seconds("n")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(
        "message_id string, source string, error string, n long, failed_at timestamp"
    ).parquet(str(tmp_path / "in"))
    got = collected(sr.retry_stream(stream.drop("n"), max_retries=3), tmp_path).orderBy("message_id", "failed_at").collect()
    assert [(r.message_id, r.attempt, r.action, r.delay_seconds) for r in got] == [
        ("m", 1, "retry", 2.0), ("m", 2, "retry", 4.0), ("m", 3, "dead_letter", None),
        ("m", 1, "retry", 2.0), ("m", 2, "retry", 4.0), ("m", 3, "dead_letter", None),
        ("m", 1, "retry", 2.0), ("n", 1, "retry", 2.0)]
    assert all((r.due_at is None) == (r.action == "dead_letter") for r in got)


def test_windowed_metrics_on_a_stream(spark, tmp_path):
    rows = [("s", "accepted", 10), ("s", "accepted", 20), ("s", "duplicate", 4000), ("s", "accepted", 90_000)]
    df = spark.createDataFrame(rows, "source string, outcome string, n long")
    df.withColumn("received_at", F.timestamp_seconds("n")).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    stream = spark.readStream.schema("source string, outcome string, n long, received_at timestamp").parquet(
        str(tmp_path / "in"))
    got = collected(ingest_metrics(stream, "1 hour", watermark="10 minutes"), tmp_path)
    # The last window is still open.
    assert sorted(r.requests for r in got.collect()) == [1, 2]


def test_live_backlog_reports_overdue_events_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    for name, rows in {
        "accepted": [[("a", 0), ("b", 10), ("c", 20), ("d", None)], [("e", 900), ("f", 5000)]],
        "done": [[("a", 30), ("b", 400)], [("e", 950), ("z", 5000)]],
    }.items():
        for batch in rows:
            spark.createDataFrame(batch, "id string, n long").withColumn("at", F.timestamp_seconds("n")).coalesce(1).write.mode(
                "append").parquet(str(tmp_path / name))
    schema = "id string, n long, at timestamp"
    accepted = spark.readStream.schema(schema).parquet(str(tmp_path / "accepted")).withColumnRenamed("at", "received_at")
    done = spark.readStream.schema(schema).parquet(str(tmp_path / "done")).select("id", F.col("at").alias("done_at"))
    got = collected(rb.backlog_stream(accepted, done, 300, 60), tmp_path)
    # b was done too late, c never; f may still be done, and comes out with a later watermark.
    assert sorted(r.id for r in got.collect() if r.id != "d") == ["b", "c"]
    spark.createDataFrame([("g", 9000)], "id string, n long").withColumn("at", F.timestamp_seconds("n")).write.mode("append").parquet(
        str(tmp_path / "accepted"))
    spark.createDataFrame([("g", 9001)], "id string, n long").withColumn("at", F.timestamp_seconds("n")).write.mode("append").parquet(
        str(tmp_path / "done"))
    got = collected(rb.backlog_stream(accepted, done, 300, 60), tmp_path)
    assert sorted(r.id for r in got.collect() if r.id != "d") == ["b", "c", "f"]


def test_stateful_ingest_waits_for_the_first_requests(spark, lookup, tmp_path):
    """Started before anything has landed, it ends without a batch, and takes up what lands later."""
    path, out, checkpoint = (str(tmp_path / name) for name in ("requests", "tables", "checkpoint"))
    (tmp_path / "requests").mkdir()
    for rows in ([], [mail(0, "a", 0), mail(1, "a", 1)]):
        if rows:
            stage_requests(requests_table(spark, *rows).coalesce(1), path)
        si.ingest_stateful(stream_requests(spark, path), lookup, out, checkpoint, once=True).awaitTermination()
    found = read_table(spark, f"{out}/outcomes").collect()
    assert sorted(r.outcome for r in found) == ["accepted", "duplicate"]

"""

``queries()`` runs every operator over the given tables; ``oracle_sql()`` states the
same results from base columns, without our JSON, where SQL can.
"""

from __future__ import annotations

import functools
import importlib
import sys
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hookloom.operators import catalog as cat
from hookloom.operators import dedupe as dd
from hookloom.operators import metrics as mt
from hookloom.operators import normalize as nm
from hookloom.operators import readback as rb
from hookloom.operators import retries as rt
from hookloom.plans import request_sets as rs
from hookloom.plans.ingest import dead_letter_table, ingest, outcome_table, reprocess_dead_letters
from hookloom.session import configure, shared_dir, stage_table
from hookloom.sources import sinks
from hookloom.sources.catalog import load_spec_catalog
from hookloom.sources.commits import write_batch
from hookloom.sources.landing import land_requests
from hookloom.sources.retention import retain_newest
from hookloom.streaming import dedupe as sd
from hookloom.streaming import ingest as si
from hookloom.streaming import retries as sr

Query = Callable[[SparkSession, str], DataFrame]

TTL_KEYS = ["event_type", "user_id"]
DAY = 24 * 3600
SPLIT = "2024-01-16"
REDELIVERY_BASE = 1.0

_lookups: dict = {}


def lookup(spark: SparkSession, signed: bool = False, redacted: bool = False) -> cat.SpecLookup:
    """The built-in specs, compiled once per session; with test variants of the mail spec."""
    configure(spark)
    key = (id(spark), spark.sparkContext.applicationId, signed, redacted)
    if key not in _lookups:
        specs = load_spec_catalog(spark)
        secrets = None
        if signed:
            specs = cat.merge_catalogs(specs, rs.signed_spec(specs))
            secrets = {rs.SIGNING_SECRET_NAME: rs.SIGNING_SECRET}
        if redacted:
            mail = specs.filter(F.col("source") == "sendgrid").withColumn("redact_raw", F.lit(True))
            specs = cat.merge_catalogs(specs, mail)
        _lookups[key] = cat.compile_lookup(specs, secrets)
    return _lookups[key]


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


# --- normalization -----------------------------------------------------------------

def normalize_shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.shop_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(
        events, {"order_id": "bigint", "total": "string", "customer_email": "string", "line_items": "json"}
    )
    return flat.withColumn("timestamp", ntz("timestamp"))


def normalize_shop_line_items(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.shop_requests(spark, sf, line_items=True), lookup(spark))
    items = F.try_variant_get(
        F.try_element_at("data", F.lit("line_items")), "$", "array<struct<title:bigint,quantity:double>>"
    )
    return events.select("external_id", F.inline(items)).select("external_id", "title", "quantity")


def normalize_mail_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.mail_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(
        events, {"email": "string", "attempt": "double", "reason": "string", "smtp_id": "string"}
    )
    return flat.select("type", "external_id", ntz("timestamp"), "email", "attempt", "reason", "smtp_id")


def normalize_pay_nested(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.pay_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(events, {
        "amount": "bigint", "currency": "string", "customer": "bigint", "billing_city": "string",
        "risk_score": "double", "livemode": "boolean", "card_brand": "string",
    })
    return flat.withColumn("timestamp", ntz("timestamp")).drop("id", "source")


def normalize_chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.chat_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(
        events, {"user": "string", "text": "string", "channel_name": "string", "channel": "json"}
    )
    return flat.withColumn("timestamp", ntz("timestamp")).drop("id", "source", "version")


def normalize_code_pages(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.code_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(
        events, {"compare": "string", "head_commit_message": "string", "sender_id": "bigint"}
    )
    return flat.withColumn("timestamp", ntz("timestamp")).drop("id", "source")


def _flat(spark: SparkSession, requests: DataFrame, fields: dict[str, str], *dropped: str) -> DataFrame:
    flat = nm.flatten_events(nm.normalize_requests(requests, lookup(spark)), fields)
    return flat.withColumn("timestamp", ntz("timestamp")).drop("id", "source", "version", *dropped)


def normalize_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, rs.issue_requests(spark, sf), {
        "summary": "string", "status": "string", "assignee": "string", "assignee_active": "boolean", "votes": "double",
    })


def normalize_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, rs.task_requests(spark, sf), {
        "number": "bigint", "state": "string", "labels": "json", "estimate": "double", "resource_type": "string",
    })


def normalize_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, rs.incident_requests(spark, sf), {
        "event_id": "string", "incident_number": "bigint", "service_name": "string",
    })


def normalize_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, rs.interaction_requests(spark, sf), {"command_name": "string", "username": "string"})


def normalize_text_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, rs.text_message_requests(spark, sf), {
        "from": "string", "body": "string", "num_media": "string",
    })


def normalize_repositories(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.repository_requests(spark, sf), lookup(spark))
    flat = nm.flatten_events(events, {"compare": "string", "sender_id": "bigint"})
    return flat.select("version", "type", "compare", "sender_id")


def scalar_text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and types that are numbers of all sizes."""
    events = nm.normalize_requests(rs.scaled_value_requests(spark, sf), lookup(spark))
    return events.select("external_id", "type")


def merged_catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog united with itself resolves each request once."""
    specs = load_spec_catalog(spark)
    known = cat.compile_lookup(cat.merge_catalogs(specs, specs))
    events = nm.normalize_requests(rs.pay_requests(spark, sf), known)
    return events.groupBy("source", "version").agg(F.count("*").alias("events"))


def resolve_versions(spark: SparkSession, sf: str) -> DataFrame:
    resolved = nm.resolve_specs(rs.pay_requests(spark, sf), lookup(spark))
    return resolved.select("request_id", "source", "version")


def type_passthrough_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.pay_requests(spark, sf), lookup(spark))
    return events.groupBy("version", "type").agg(F.count("*").alias("events"))


def redact_raw_check(spark: SparkSession, sf: str) -> DataFrame:
    mail = nm.normalize_requests(rs.mail_requests(spark, sf), lookup(spark, redacted=True))
    pay = nm.normalize_requests(rs.pay_requests(spark, sf), lookup(spark, redacted=True))
    return mail.unionByName(pay).groupBy("source").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("raw").isNull()).alias("without_raw"),
        F.count_if(F.col("data").isNotNull()).alias("with_data"),
    )


# --- gates -------------------------------------------------------------------------

def classify_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    result = ingest(rs.bulk_requests(spark, sf), lookup(spark))
    return result.outcomes.select("request_id", "source", "version", "type", "outcome", "status", "event_id")


def body_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = nm.classify_requests(rs.text_requests(spark, sf), lookup(spark), max_body=2000)
    return outcome_table(rows).groupBy("outcome", "status").agg(F.count("*").alias("requests"))


def json_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = nm.classify_requests(rs.bulk_requests(spark, sf), lookup(spark))
    invalid = rows.filter(F.col("outcome") == "invalid_json")
    return invalid.select("request_id", "source")


def signature_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = nm.classify_requests(rs.signed_requests(spark, sf), lookup(spark, signed=True))
    return outcome_table(rows).select("request_id", "outcome", "status", "reason")


def unserializable_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    rows = dead_letter_table(nm.classify_requests(rs.bulk_requests(spark, sf), lookup(spark)))
    return rows.select("request_id", "external_id", "reason")


# --- deduplication -----------------------------------------------------------------

def _timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return rs.table(spark, sf, "events").withColumn("request_id", F.col("event_id").cast("string"))


def dedupe_ttl_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = dd.dedupe_ttl(_timed_events(spark, sf), keys=TTL_KEYS, ttl_seconds=DAY, time="ts")
    return rows.select("event_id", "accepted")


def dedupe_ttl_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same with few, large keys, all cut into slices."""
    rows = dd.dedupe_ttl(
        _timed_events(spark, sf), keys=["event_type"], ttl_seconds=3600, time="ts", hot_rows=100,
        stage=lambda df: stage_table(df, "repeated"),
    )
    return rows.select("event_id", "accepted")


def dedupe_against_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = _timed_events(spark, sf)
    cut = F.col("ts") < F.lit(SPLIT).cast("timestamp")
    earlier = dd.dedupe_ttl(rows.filter(cut), keys=TTL_KEYS, time="ts").filter("accepted")
    later = dd.dedupe_ttl(rows.filter(~cut), keys=TTL_KEYS, time="ts", history=earlier)
    return earlier.unionByName(later).select("event_id", "accepted").filter("accepted")


def drop_already_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = _timed_events(spark, sf)
    cut = F.col("ts") < F.lit(SPLIT).cast("timestamp")
    fresh = dd.drop_already_seen(rows.filter(~cut), rows.filter(cut), TTL_KEYS, time="ts")
    return fresh.select("event_id")


def dedupe_empty_id_bypass(spark: SparkSession, sf: str) -> DataFrame:
    result = ingest(rs.code_requests(spark, sf), lookup(spark), ttl_seconds=10**6)
    return result.events.groupBy("type").agg(F.count("*").alias("events"))


def ingest_mail(spark: SparkSession, sf: str) -> DataFrame:
    result = ingest(rs.mail_requests(spark, sf, shared_ids=True), lookup(spark))
    return result.outcomes.select("request_id", "type", "outcome", "status")


def ingest_mail_events(spark: SparkSession, sf: str) -> DataFrame:
    result = ingest(rs.mail_requests(spark, sf, shared_ids=True), lookup(spark))
    return nm.flatten_events(result.events, {"email": "string"}).select("id", "type", "external_id", "email")


# --- read-back ---------------------------------------------------------------------

def _store(rows: DataFrame, write: Callable[[DataFrame, str], None]) -> DataFrame:
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hookloom/store-{uuid.uuid4().hex}"
    write(rows, path)
    return sinks.read_table(spark, path)


def store_events(spark: SparkSession, sf: str) -> DataFrame:
    events = nm.normalize_requests(rs.pay_requests(spark, sf), lookup(spark))
    stored = _store(events, sinks.write_events)
    return stored.groupBy("source", "type").agg(
        F.count("*").alias("events"),
        F.sum(F.try_variant_get(F.try_element_at("data", F.lit("amount")), "$", "bigint")).alias("amount"),
    )


def store_numeric_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that look like numbers keep their leading zeros."""
    number = F.substring("external_id", 2, 20).cast("int") % 20
    rows = rs.stored_events(spark, sf).withColumn("source", F.lpad(number.cast("string"), 3, "0"))
    return _store(rows, sinks.write_events).groupBy("source").agg(F.count("*").alias("events"))


def read_landed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests landed as a table and read again."""
    from hookloom.sources.requests import read_requests

    path = f"{shared_dir(spark).rstrip('/')}/hookloom/landed-{uuid.uuid4().hex}"
    sinks.stage_requests(rs.text_requests(spark, sf).drop("doc_id"), path)
    rows = read_requests(spark, path)
    return rows.select(
        "request_id", "source", F.octet_length("body").cast("long").alias("body_bytes"), ntz("received_at")
    )


def event_by_id(spark: SparkSession, sf: str) -> DataFrame:
    events = rs.stored_events(spark, sf).withColumn("id", F.col("external_id"))
    ids = rs.table(spark, sf, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("id"))
    return rb.event_by_id(events, ids).select("id", "source", "type", ntz("stored_at"), "value")


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = rb.latest_events(rs.stored_events(spark, sf), "click", 250)
    return rows.select("id", "type", ntz("stored_at"))


def latest_events_per_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = rb.newest_per_group(rs.stored_events(spark, sf), 40, ("source", "type"))
    return rows.select("id", "source", "type")


def trim_events(spark: SparkSession, sf: str) -> DataFrame:
    return rb.trim_events(rs.stored_events(spark, sf), 1200).select("id", "source")


def retain_events(spark: SparkSession, sf: str) -> DataFrame:
    """Four committed batches of events, of which only those at the edge of the history are rewritten."""
    base = _fresh(spark, "retain")
    events = rs.stored_events(spark, sf)
    batch = F.floor((F.day("stored_at") - 1) / 8)
    for number in range(4):
        rows = events.filter(batch == number)

        def write(attempt: str) -> dict[str, None]:
            sinks.write_events(rows, f"{base}/events", number, attempt=attempt)
            return {"events": None}

        write_batch(spark, base, number, write)
    retain_newest(spark, base, n=1200)
    return sinks.read_table(spark, f"{base}/events").select("id", "source")


def trim_queue(spark: SparkSession, sf: str) -> DataFrame:
    return rb.trim_table(rs.stored_events(spark, sf), 3000, "stored_at", "id").select("id")


def replay_listing(spark: SparkSession, sf: str) -> DataFrame:
    return rb.replay_listing(rs.stored_events(spark, sf), "purchase")


def skip_corrupt_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = rs.failures(spark, sf)
    return rb.corrupt_counts(entries, "payload")


def parse_stored_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = rb.parse_stored(rs.failures(spark, sf), "payload")
    return entries.select("failure_id", F.try_variant_get("parsed", "$.k", "bigint").alias("k"))


# --- catalog -----------------------------------------------------------------------

def list_specs(spark: SparkSession, sf: str) -> DataFrame:
    return cat.list_specs(rs.spec_rows(spark, sf))


def validate_specs(spark: SparkSession, sf: str) -> DataFrame:
    return cat.validate_specs(rs.spec_rows(spark, sf))


def latest_specs(spark: SparkSession, sf: str) -> DataFrame:
    return cat.latest_specs(rs.spec_rows(spark, sf)).select("source", "version", "type_header")


def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalog_coverage(rs.spec_rows(spark, sf))


def spec_types(spark: SparkSession, sf: str) -> DataFrame:
    return cat.spec_types(rs.spec_rows(spark, sf))


def merge_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """Specs per order, overridden by specs per customer and status."""
    specs = rs.spec_rows(spark, sf).filter("source <> '' and version <> ''")
    custom = specs.filter(F.map_contains_key("type_mapping", "F")).withColumn("type_header", F.lit("X-Custom"))
    return cat.merge_catalogs(specs, custom).select("source", "version", "type_header")


def resolve_large_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against a catalog that grows with the data, so the join is not broadcast."""
    specs = rs.spec_rows(spark, sf).filter("source <> '' and version <> ''")
    specs = specs.withColumn("type_field", F.lit("kind")).withColumn("type_header", F.lit(""))
    specs = specs.withColumn("signature_header", F.lit(""))
    large = cat.compile_lookup(specs, validate=False, max_bytes=1000)
    requests = rs.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.concat(F.lit("shop-"), "c_custkey").alias("source"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast("string").alias("query_version"),
        F.to_json(F.struct(
            F.col("c_custkey").alias("id"), F.lit("F").alias("kind"),
            F.struct(F.col("c_acctbal").alias("total")).alias("order"),
        )).cast("binary").alias("body"),
        F.timestamp_seconds(F.col("c_custkey")).alias("received_at"),
    )
    events = nm.normalize_requests(requests, large)
    return nm.flatten_events(events, {"total": "double"}).select("source", "version", "type", "total")


# --- metrics -----------------------------------------------------------------------

def _bulk_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest(rs.bulk_requests(spark, sf), lookup(spark)).outcomes


def metrics_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return mt.outcome_metrics(_bulk_outcomes(spark, sf))


def events_ingested(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_events_ingested(_bulk_outcomes(spark, sf))


def ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_ingest_errors(_bulk_outcomes(spark, sf))


def events_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_deduplicated(_bulk_outcomes(spark, sf))


def signature_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = nm.classify_requests(rs.signed_requests(spark, sf), lookup(spark, signed=True))
    return mt.metric_signature_failures(outcome_table(rows))


def events_stored(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_stored(rs.stored_events(spark, sf))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = rs.table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        F.when(F.col("user_id") % 3 == 0, 202).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("latency_seconds"),
    )
    return mt.latency_histogram(rows)


def latency_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """Arrival to store, from the outcome and event tables of an ingested batch, as a histogram; and
    whether the 0.99 quantile of hourly sketches, merged, lies within its error."""
    base = _fresh(spark, "latency")
    result = ingest(rs.mail_requests(spark, sf), lookup(spark))
    number = F.substring("external_id", 4, 20).cast("long")
    stored_at = F.timestamp_micros(F.unix_micros("received_at") + (number * 7919 % 12_000) * 1000)
    sinks.write_events(result.events.withColumn("stored_at", stored_at), f"{base}/events", spread=True)
    sinks.write_outcomes(result.outcomes, f"{base}/outcomes")
    rows = mt.store_latencies(sinks.read_table(spark, f"{base}/outcomes"), sinks.read_table(spark, f"{base}/events"))
    by = ["source", "status"]
    hourly = mt.latency_sketches(rows.withColumn("hour", F.date_trunc("hour", "received_at")), [*by, "hour"])
    p99 = mt.latency_quantiles(mt.merge_sketches(hourly, by), by, [0.99]).select(*by, "seconds")
    rank = rows.join(F.broadcast(p99), by).groupBy(*by).agg(
        (F.abs(F.count_if(F.col("latency_seconds") <= F.col("seconds")) / F.count("*") - 0.99) < 0.01).alias("p99_within_error")
    )
    return mt.latency_histogram(rows, by).join(rank, by)


def windowed_ingest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    result = ingest(rs.mail_requests(spark, sf, shared_ids=True), lookup(spark))
    rows = mt.ingest_metrics(result.outcomes, "6 hours")
    return rows.withColumn("window_start", ntz("window_start"))


def backlog(spark: SparkSession, sf: str) -> DataFrame:
    events = rs.stored_events(spark, sf)
    stored = events.filter(F.col("source") != "click")
    dead = events.filter((F.col("source") == "click") & (F.col("value") > 50))
    return rb.backlog(events, stored, dead).select("id", "source")


# --- retries and dead letters --------------------------------------------------------

def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return rt.plan_retries(rt.attempt_counts(rs.failures(spark, sf), window_seconds=48 * 3600), max_retries=3)


def attempt_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = rt.attempt_counts(rs.failures(spark, sf), window_seconds=48 * 3600)
    return rows.select("message_id", "attempts", ntz("failed_at"), "source", "error")


def plan_retries(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select("message_id", "attempts", "action", "delay_seconds", ntz("due_at"))


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return rt.route_dead_letters(_plan(spark, sf)).select(
        "message_id", "source", "reason", "attempts", "readable", ntz("failed_at")
    )


def events_dead_lettered(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_dead_lettered(rt.route_dead_letters(_plan(spark, sf)))


def events_retried(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_retried(_plan(spark, sf))


def reprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Dead-lettered events ingested again, against the events accepted before."""
    known = lookup(spark)
    events = nm.normalize_requests(rs.pay_requests(spark, sf), known)
    dead = events.filter(F.col("type") == "payment.charge_failed")
    even = F.try_variant_get(F.try_element_at("data", F.lit("amount")), "$", "bigint") % 2 == 0
    accepted = events.filter((F.col("type") != "payment.charge_failed") | even)
    again = reprocess_dead_letters(dead, known, history=accepted)
    return again.outcomes.select("request_id", "version", "type", "outcome")


def reprocess_shop(spark: SparkSession, sf: str) -> DataFrame:
    """Shop events, whose type comes from a header, failed until dead-lettered and ingested again."""
    requests = rs.shop_requests(spark, sf)
    events = nm.normalize_requests(requests, lookup(spark)).join(requests.select("request_id", "headers"), "request_id")
    # Failures are read several times; their events are worked out once, and each payload is written once.
    events = stage_table(events.select(
        F.col("request_id").alias("message_id"), "source", "headers",
        F.to_json(F.struct("request_id", "source", "version", "raw")).alias("payload"), "received_at",
    ), "failed-events")
    failed = events.select("*", F.explode(F.array(*(F.lit(n) for n in range(3)))).alias("n")).select(
        F.concat_ws("-", "message_id", "n").alias("failure_id"), "message_id", "source", "headers", "payload",
        F.lit("store event").alias("error"), (F.col("received_at") + F.make_dt_interval(secs=F.col("n"))).alias("failed_at"),
    )
    counts = rt.attempt_counts(failed, stage=lambda df: stage_table(df, "failures"))
    plan = rt.plan_retries(counts, max_retries=3)
    dead = rt.events_from_payload(rt.route_dead_letters(plan))
    again = ingest(rt.dead_letters_as_requests(dead), lookup(spark), ttl_seconds=1)
    marked = again.outcomes.select("request_id", "type", "outcome")
    return marked.select(F.substring("request_id", 7, 30).alias("external_id"), "outcome", "type")


# --- streams -----------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_stream(stream: DataFrame, mode: str = "append", bounded: bool = True) -> DataFrame:
    """Run a stream over the data there is and return what it wrote."""
    spark = stream.sparkSession
    sd.stream_settings(spark, bounded=True)
    if not bounded:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    base = f"{shared_dir(spark).rstrip('/')}/hookloom/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/hookloom/{name}-{uuid.uuid4().hex}"


def stream_dedupe_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """One claim per key: the run is shorter than the TTL. Whole rows are marked, by files."""
    configure(spark)
    sd.stream_settings(spark, bounded=True)
    base = _fresh(spark, "dedupe")
    schema = T.StructType([f if f.name != "ts" else T.StructField("ts", T.TimestampType()) for f in rs.table(spark, sf, "events").schema])
    rs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/events")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/marked/batch_id={batch_id}")

    sd.dedupe_files(
        spark, f"{base}/events", schema, write, f"{base}/checkpoint", DAY, TTL_KEYS, "ts", "event_id", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/marked").groupBy(*TTL_KEYS).agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("duplicates")
    )


def stream_dedupe_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key: the watermark only moves between micro-batches."""
    configure(spark)
    rows = sd.dedupe_watermark(_event_stream(spark, sf), DAY, TTL_KEYS, "ts")
    return _run_stream(rows.select("ts", *TTL_KEYS)).select(*TTL_KEYS)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Chat webhooks landed as files, ingested as a stream into tables."""
    from hookloom.sources.requests import stream_requests

    known = lookup(spark)
    base = f"{shared_dir(spark).rstrip('/')}/hookloom/ingest-{uuid.uuid4().hex}"
    sinks.stage_requests(rs.chat_requests(spark, sf), f"{base}/requests")
    query = si.ingest_batches(
        stream_requests(spark, f"{base}/requests"), known, base, f"{base}/checkpoint", once=True
    )
    query.awaitTermination()
    stored = sinks.read_table(spark, f"{base}/events")
    return stored.select("external_id", "type", ntz("timestamp"))


def stream_ingest_landings(spark: SparkSession, sf: str) -> DataFrame:
    """Chat webhooks landed in committed batches, two of them a micro-batch, cleared once ingested."""
    base = _fresh(spark, "landings")
    requests = rs.chat_requests(spark, sf)
    for number in range(3):
        land_requests(requests.filter(F.pmod(F.crc32("request_id"), F.lit(3)) == number), f"{base}/in", number)
    query = si.ingest_landings(
        spark, f"{base}/in", lookup(spark), f"{base}/out", f"{base}/checkpoint", max_batches=2, clear=True, once=True
    )
    query.awaitTermination()
    stored = sinks.read_table(spark, f"{base}/out/events")
    return stored.select("external_id", "type", ntz("timestamp"))


def stream_ingest_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents ingested as a stream; entries of the three tables it writes."""
    from hookloom.sources.requests import stream_requests

    base = f"{shared_dir(spark).rstrip('/')}/hookloom/ingest-{uuid.uuid4().hex}"
    sinks.stage_requests(rs.bulk_requests(spark, sf).drop("doc_id"), f"{base}/requests")
    query = si.ingest_batches(
        stream_requests(spark, f"{base}/requests"), lookup(spark), base, f"{base}/checkpoint", once=True
    )
    query.awaitTermination()
    outcome = {"outcomes": F.col("outcome"), "dead_letters": F.lit("unserializable"), "events": F.lit("accepted")}
    tables = [
        sinks.read_table(spark, f"{base}/{kind}").select(F.lit(kind).alias("kind"), value.alias("outcome"))
        for kind, value in outcome.items()
    ]
    return tables[0].union(tables[1]).union(tables[2]).groupBy("kind", "outcome").agg(F.count("*").alias("entries"))


def stream_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Events neither stored nor dead-lettered five minutes after they arrived, as two streams are joined."""
    configure(spark)
    accepted = _event_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").alias("received_at")
    )
    done = _event_stream(spark, sf).filter(F.col("value") <= 50).select(
        F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(mins=F.col("user_id").cast("int") % 8)).alias("done_at")
    )
    # An empty micro-batch after the last one moves the watermark over it.
    overdue = _run_stream(rb.backlog_stream(accepted, done, 300, 60), bounded=False)
    return overdue.filter(F.col("received_at") < SPLIT).select("id", "source")


def stream_retry_decisions(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    failures = _event_stream(spark, sf).select(
        F.concat(F.lit("msg-"), "user_id").alias("message_id"),
        F.col("event_type").alias("source"),
        F.col("event_type").alias("error"),
        F.col("ts").alias("failed_at"),
    )
    rows = _run_stream(sr.retry_stream(failures, max_retries=3))
    return rows.groupBy("message_id").agg(
        F.count_if(F.col("action") == "retry").alias("retries"),
        F.count_if(F.col("action") == "dead_letter").alias("dead_letters"),
    )


def stream_redeliver(spark: SparkSession, sf: str) -> DataFrame:
    """Failed messages handed on again when due: events land as failures in two files, and the
    second run, when all of the first file's retries are due, fires their timers."""
    configure(spark)
    sd.stream_settings(spark, bounded=True)
    base = _fresh(spark, "redeliver")
    events = rs.table(spark, sf, "events")
    failures = events.select(
        F.concat(F.lit("msg-"), "user_id").alias("message_id"), F.col("event_type").alias("source"),
        F.col("event_type").alias("error"), F.current_timestamp().alias("failed_at"),
        F.col("event_id").cast("string").alias("payload"), (F.col("ts") < SPLIT).alias("early"),
    )
    out = None
    for early in (True, False):
        failures.filter(F.col("early") == early).drop("early").write.mode("append").parquet(f"{base}/failures")
        stream = spark.readStream.schema(failures.drop("early").schema).parquet(f"{base}/failures")
        rows = sr.redelivery_stream(stream, max_retries=3, base_seconds=REDELIVERY_BASE)
        query = (
            rows.writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        out = out or rows.schema
        if early:
            time.sleep(4 * REDELIVERY_BASE)  # the longest delay: base * 2^2
    # Retries of the second file may still wait; those of the first have all come out.
    first = events.filter(F.col("ts") < SPLIT).select(F.col("event_id").cast("string").alias("payload"))
    done = spark.read.schema(out).parquet(f"{base}/out").withColumn("dead", F.col("action") == "dead_letter")
    dead = done.filter("dead").groupBy("message_id").agg(F.count("*").alias("dead_letters"))
    again = done.filter("NOT dead").join(first, "payload", "left_semi").groupBy("message_id").agg(F.count("*").alias("redelivered"))
    return again.join(dead, "message_id", "full").select(
        "message_id", F.coalesce("redelivered", F.lit(0)).alias("redelivered"), F.coalesce("dead_letters", F.lit(0)).alias("dead_letters")
    )


# --- contract ----------------------------------------------------------------------

_QUERIES: tuple[Query, ...] = (
    normalize_shop_orders, normalize_shop_line_items, normalize_mail_timestamps, normalize_pay_nested,
    normalize_chat_messages, normalize_code_pages, normalize_issues, normalize_tasks, normalize_incidents,
    normalize_interactions, normalize_text_messages, normalize_repositories, scalar_text_forms, merged_catalog_lookup,
    store_numeric_sources, read_landed_requests, reprocess_shop, stream_ingest_tables, resolve_versions, type_passthrough_counts,
    redact_raw_check, classify_outcomes, body_size_gate, json_gate, signature_gate,
    unserializable_dead_letters, dedupe_ttl_events, dedupe_ttl_hot_keys, dedupe_against_history,
    drop_already_seen, dedupe_empty_id_bypass, ingest_mail, ingest_mail_events, store_events,
    event_by_id, latest_events, latest_events_per_source, trim_events, trim_queue, replay_listing,
    skip_corrupt_entries, parse_stored_entries, list_specs, validate_specs, latest_specs,
    catalog_coverage, spec_types, merge_catalogs, resolve_large_catalog, metrics_by_source,
    events_ingested, ingest_errors, events_deduplicated, signature_failures, events_stored,
    latency_histogram, windowed_ingest_metrics, backlog, attempt_counts, plan_retries, dead_letters,
    events_dead_lettered, events_retried, reprocess, stream_dedupe_ttl, stream_dedupe_watermark,
    stream_ingest, stream_retry_decisions, stream_redeliver, stream_backlog, latency_from_store,
    retain_events, stream_ingest_landings,
)


def entry(spark: SparkSession) -> DataFrame:
    configure(spark)
    return normalize_shop_orders(spark, "/root/testdata/sf0.001")


def _configured(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return query(spark, sf_dir)

    return run


def _corpus_part(name: str):
    """A module of the corpus operators, or None where that part can not be imported."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def core_queries() -> dict[str, Query]:
    """Queries of the webhook engine itself."""
    return {query.__name__: _configured(query) for query in _QUERIES}


def queries() -> dict[str, Query]:
    own = core_queries()
    if corpus := _corpus_part("hookloom.llm.queries"):
        own |= {name: _configured(query) for name, query in corpus.queries().items()}
        if pipeline := _corpus_part("corpus_pipeline"):
            own["pipeline"] = _configured(pipeline.run)
    return own


def oracle_sql() -> dict[str, str]:
    from hookloom.plans.oracles import ORACLES

    own = dict(ORACLES)
    if corpus := _corpus_part("hookloom.llm.queries"):
        own |= corpus.oracle_sql()
    return own

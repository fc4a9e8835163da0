"""Retry plans over a table of failures, and work on dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.functions.payload import strict_document
from hookloom.functions.requests import retry_delay_seconds
from hookloom.operators.dedupe import DAY, ttl_duplicates
from hookloom.operators.normalize import computed_once
from hookloom.schemas import REQUESTS

MAX_RETRIES = 5


def attempt_counts(
    failures: DataFrame, window_seconds: float = DAY, failure_id: str = "failure_id",
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Attempts per message as its expiring counter shows them.

    The counter starts at a message's first failure, lives ``window_seconds`` without
    being extended, and starts again with the next failure. A start thus is a claim of
    the message with that TTL; failures since the last start are counted. The last
    failure's source, error, payload and, where there are any, request headers are kept:
    only ids and times are shuffled to find it. ``stage`` writes a table and reads it back, so that
    failures are read twice, once for ids and times and once for what is kept.
    """
    slim = failures.select("message_id", "failed_at", F.col(failure_id).alias("failure_id"))
    slim = slim if stage is None else stage(slim)
    repeats = ttl_duplicates(
        slim, keys=["message_id"], ttl_seconds=window_seconds, time="failed_at", row_id="failure_id", stage=stage
    )
    starts = slim.join(repeats.withColumnRenamed("request_id", "failure_id"), "failure_id", "left_anti")
    last_start = starts.groupBy("message_id").agg(F.max("failed_at").alias("counter_start"))
    counted = (
        slim.join(last_start, "message_id")
        .filter(F.col("failed_at") >= F.col("counter_start"))
        .groupBy("message_id")
        .agg(F.count("*").alias("attempts"), F.max(F.struct("failed_at", "failure_id")).alias("last"))
        .select("message_id", "attempts", "last.failed_at", F.col("last.failure_id").alias("last_failure"))
    )
    carried = [name for name in ("source", "error", "payload", "headers") if name in failures.columns]
    details = failures.select(F.col(failure_id).alias("last_failure"), *carried)
    return counted.join(details, "last_failure").select("message_id", "attempts", "failed_at", *carried)


def effective_limit(max_retries: int) -> int:
    return max_retries if max_retries > 0 else MAX_RETRIES


def plan_retries(
    attempts: DataFrame, max_retries: int = MAX_RETRIES, base_seconds: float = 1.0,
    first_delay_doubled: bool = True,
) -> DataFrame:
    """What to do with each failed message: retry after a growing delay, or dead-letter it.

    The n-th failure waits base * 2^n; without ``first_delay_doubled`` base * 2^(n-1).
    """
    limit = effective_limit(max_retries)
    exponent: Column = F.col("attempts") if first_delay_doubled else F.col("attempts") - 1
    again = F.col("attempts") < limit
    delay = F.when(again, retry_delay_seconds(base_seconds, exponent))
    return attempts.select(
        "*",
        F.when(again, "retry").otherwise("dead_letter").alias("action"),
        delay.alias("delay_seconds"),
        F.timestamp_micros(
            F.unix_micros("failed_at") + (delay * 1_000_000).cast("bigint")
        ).alias("due_at"),
    )


def route_dead_letters(plan: DataFrame) -> DataFrame:
    """Exhausted messages with their last error; unreadable payloads are kept and marked."""
    dead = plan.filter(F.col("action") == "dead_letter")
    return dead.select(
        "message_id",
        "source",
        "payload",
        strict_document(F.col("payload")).isNotNull().alias("readable"),
        F.col("error").alias("reason"),
        F.col("attempts").cast("int").alias("attempts"),
        "failed_at",
        *(["headers"] if "headers" in plan.columns else []),
    )


def events_from_payload(dead_letters: DataFrame) -> DataFrame:
    """Rows of `route_dead_letters` with the fields of the event in their payload.

    Request headers come with the dead letter or, failing that, from the payload; specs
    that take the event type from a header need them.
    """
    event = F.col("_event")
    text = lambda path: F.try_variant_get(event, path, "string")
    headers = F.try_variant_get(event, "$.headers", "map<string,string>")
    if "headers" in dead_letters.columns:
        headers = F.coalesce("headers", headers)
    # Parsed once, also when later steps filter by what is read from it; checked by `readable`.
    parsed = computed_once(dead_letters.filter("readable"), _event=F.try_parse_json("payload"))
    return parsed.select(
        F.coalesce(text("$.request_id"), "message_id").alias("request_id"),
        F.coalesce(text("$.source"), "source").alias("source"),
        text("$.version").alias("version"),
        F.try_variant_get(event, "$.raw", "variant").alias("raw"),
        headers.alias("headers"),
        F.col("failed_at").alias("received_at"),
        "reason",
        "attempts",
    )


def dead_letters_as_requests(dead_letters: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Dead-lettered events in request shape, to be ingested again.

    The body is the event's raw payload, so redacted events are left out: they can not
    be rebuilt. ``headers`` must be kept with the dead letter for specs that take the
    event type from a header.
    """
    headers = (
        F.col("headers") if "headers" in dead_letters.columns
        else F.lit(None).cast("map<string,string>")
    )
    # Arrival stays what it was unless the caller sets a new one.
    arrival = F.col("received_at") if received_at is None else received_at
    return dead_letters.filter(F.col("raw").isNotNull()).select(
        "request_id",
        "source",
        headers.alias("headers"),
        F.col("version").alias("query_version"),
        F.to_json("raw").cast("binary").alias("body"),
        arrival.alias("received_at"),
    ).select(*REQUESTS.names)

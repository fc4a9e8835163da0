"""The whole batch: requests in, events, outcomes and dead letters out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookloom.operators.catalog import SpecLookup
from hookloom.operators.dedupe import DAY, EVENT_KEYS, HOT_ROWS, mark_duplicates, ttl_duplicates
from hookloom.operators.normalize import EVENT_COLUMNS, MAX_BODY_BYTES, classify_requests, outcome_status
from hookloom.operators.retries import dead_letters_as_requests
from hookloom.session import stage_table


class Ingested(NamedTuple):
    events: DataFrame
    outcomes: DataFrame
    dead_letters: DataFrame


def outcome_table(classified: DataFrame) -> DataFrame:
    """One row per request with its answer."""
    return classified.select(
        "request_id",
        "source",
        "version",
        "type",
        "outcome",
        outcome_status(F.col("outcome")).alias("status"),
        "reason",
        F.when(F.col("outcome").isin("accepted", "duplicate"), F.col("id")).alias("event_id"),
        "received_at",
    )


def dead_letter_table(classified: DataFrame) -> DataFrame:
    """Requests whose event can not be serialized; they claim no key."""
    lost = classified.filter(F.col("outcome") == "unserializable")
    return lost.select(
        *EVENT_COLUMNS,
        "headers",
        F.concat(F.lit("timestamp out of range: "), F.col("timestamp_micros")).alias("reason"),
        F.lit(0).alias("attempts"),
        F.col("received_at").alias("failed_at"),
    )


def ingest(
    requests: DataFrame,
    lookup: SpecLookup,
    history: DataFrame | Callable[[DataFrame], DataFrame | None] | None = None,
    ttl_seconds: float = DAY,
    keys: tuple[str, ...] = EVENT_KEYS,
    max_body: int = MAX_BODY_BYTES,
    hot_rows: int = HOT_ROWS,
    staged: bool = True,
    stage_dir: str | None = None,
) -> Ingested:
    """Classify, normalize and deduplicate a batch.

    ``history`` holds the events accepted before, at least those of the last TTL; pass
    it filtered to those, or a function that makes it from the classified rows. With ``staged``, normalized rows and the ids of duplicates are
    written once to the session's shared folder: bodies are then parsed a single time and
    the passes over keys read just their columns. Without it the plan stays lazy and
    repeats the parse per pass. A ``stage_dir`` is used instead, and overwritten, so that
    repeated batches keep one staged copy; results must be written before the next batch.
    """
    def stage(df: DataFrame, name: str) -> DataFrame:
        return stage_table(df, name, stage_dir and f"{stage_dir}/{name}") if staged else df

    classified = stage(classify_requests(requests, lookup, max_body), "classified")
    candidates = classified.filter(F.col("outcome") == "accepted")
    if callable(history):
        history = history(classified)
    duplicates = ttl_duplicates(
        candidates, keys, ttl_seconds, history=history, hot_rows=hot_rows,
        stage=(lambda df: stage(df, "repeated")) if staged else None,
    )
    duplicates = stage(duplicates, "duplicates")
    marked = mark_duplicates(classified, duplicates)
    final = F.when(~F.col("accepted"), "duplicate").otherwise(F.col("outcome"))
    events = candidates.join(duplicates, "request_id", "left_anti").select(*EVENT_COLUMNS)
    return Ingested(
        events, outcome_table(marked.withColumn("outcome", final)), dead_letter_table(classified)
    )


def reprocess_dead_letters(dead_letters: DataFrame, lookup: SpecLookup, **options) -> Ingested:
    """Ingest dead letters again, against the history given in ``options``."""
    return ingest(dead_letters_as_requests(dead_letters), lookup, **options)

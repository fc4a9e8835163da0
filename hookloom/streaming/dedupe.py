"""Deduplication on streams: exact with keyed state, or cheaper with a watermark.

Exact deduplication keeps payloads out of the state: what enters it is a row's key, time and
id. The state's answer is the ids of accepted rows and the names of the files they came
from; whole rows of those files are then marked in each micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hookloom.operators.dedupe import DAY, EVENT_KEYS, has_key
from hookloom.session import shared_dir, stage_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_settings(spark, bounded: bool = False) -> None:
    """Settings of keyed state; a run that must end by itself needs ``bounded``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if bounded:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


class ClaimProcessor(StatefulProcessor):
    """Answers with a key's first arrival and forgets the key when its TTL has run out."""

    def __init__(self, ttl_seconds: float) -> None:
        self.ttl_ms = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "claimed boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        if key[-1] is not None:
            yield Row(row_id=None, file=key[-1])  # a file that was read, not a claim
        # Written only when absent, so a repeat does not extend the claim.
        elif not self.seen.exists():
            self.seen.update((True,))
            yield Row(row_id=min((row["at"], row["row_id"]) for row in rows)[1], file=None)

    def close(self) -> None:
        pass


def _first_per_key(keys: Sequence[str]):
    """The first row of each key in an Arrow batch, and a row per file it came from.

    All rows of a micro-batch arrive at one instant of the processing clock, so at most one
    of a key is a claim. Later ones need no state; leaving them out here keeps a hot key's rows
    from meeting in one task.
    """
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            claims = batch[batch["eligible"]].sort_values(["at", "row_id"], kind="stable").drop_duplicates(keys)
            files = batch.drop_duplicates("file")[["file"]]
            rows = pd.concat([claims.assign(file=None), files]).reindex(columns=[*keys, "at", "row_id", "file"])
            yield rows.astype({"at": "Int64"}).astype(object).where(rows.notna(), None)

    return first


def accepted_claims(
    rows: DataFrame, ttl_seconds: float = DAY, keys: Sequence[str] = EVENT_KEYS, time: str = "received_at",
    row_id: str = "request_id", eligible: Column | None = None, file: Column | None = None,
) -> DataFrame:
    """Ids of streaming rows that claim their key, as ``row_id``, and the ``file`` names seen.

    Rows that are not ``eligible`` (by default, have no key) claim nothing. A row of the result holds
    either an id or a file name. Expiry follows the processing clock, as arrival does; ties in a
    micro-batch go to the earliest ``time``, then the smallest id. Call `stream_settings` first.
    """
    named = [f"key{i}" for i in range(len(keys))]
    eligible = has_key(rows, keys) if eligible is None else eligible & has_key(rows, keys)
    slim = rows.select(
        *(F.col(key).cast("string").alias(name) for key, name in zip(keys, named)), F.unix_micros(time).alias("at"),
        F.col(row_id).cast("string").alias("row_id"), F.coalesce(eligible, F.lit(False)).alias("eligible"),
        (F.lit("") if file is None else file).alias("file"),
    )
    # A row is a claim or a file, so every column may be null.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in slim.schema if f.name != "eligible"])
    return slim.mapInPandas(_first_per_key(named), schema).groupBy(*named, "file").transformWithState(
        statefulProcessor=ClaimProcessor(ttl_seconds), outputStructType="row_id string, file string",
        outputMode="Append", timeMode="ProcessingTime",
    )


def dedupe_files(
    spark: SparkSession, path: str, schema: T.StructType, write: Callable[[DataFrame, int], None], checkpoint: str,
    ttl_seconds: float = DAY, keys: Sequence[str] = EVENT_KEYS, time: str = "received_at", row_id: str = "request_id",
    eligible: Callable[[DataFrame], Column] | None = None, once: bool = False, **options,
) -> StreamingQuery:
    """Deduplicate parquet files as they arrive: ``write(rows, batch_id)`` gets whole rows with boolean ``accepted``.

    The state sees only keys, times and ids, read from those columns of the files. A
    micro-batch's whole rows are then read from its files and marked by a join with the accepted ids;
    a file is never split between micro-batches. Rows without a key or not ``eligible`` come out accepted.
    ``row_id`` must be unique. Options go to the file source.
    """
    stream_settings(spark)
    stream = spark.readStream.schema(schema).options(**options).parquet(path)
    may_claim = eligible(stream) if eligible else None
    claims = accepted_claims(stream, ttl_seconds, keys, time, row_id, may_claim, F.col("_metadata.file_path"))
    # One folder for the ids of a micro-batch, overwritten by the next.
    staged = f"{shared_dir(spark).rstrip('/')}/hookloom/claims-{uuid.uuid4().hex}"

    def mark(batch: DataFrame, batch_id: int) -> None:
        found = stage_table(batch, "claims", staged)
        files = [unquote(row.file) for row in found.filter("file IS NOT NULL").select("file").distinct().collect()]
        if not files:
            return
        rows = spark.read.schema(schema).option("basePath", path).parquet(*sorted(files))
        claimed = found.filter("row_id IS NOT NULL").select(F.col("row_id").alias("_claimed"))
        joined = rows.join(claimed, rows[row_id].cast("string") == F.col("_claimed"), "left")
        claims_key = has_key(rows, keys) if eligible is None else eligible(rows) & has_key(rows, keys)
        accepted = F.col("_claimed").isNotNull() | ~F.coalesce(claims_key, F.lit(False))
        write(joined.select(*rows.columns, accepted.alias("accepted")), batch_id)

    writer = claims.writeStream.foreachBatch(mark).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dedupe_watermark(
    events: DataFrame, ttl_seconds: float = DAY, keys: Sequence[str] = EVENT_KEYS, time: str = "received_at",
) -> DataFrame:
    """Accepted rows only, by event time and without Python workers.

    Looser than keyed state: a key expires with the watermark, so it may live
    longer than the TTL, and rows behind the watermark are dropped. Rows without a key
    must be split off before.
    """
    return events.withWatermark(time, f"{int(ttl_seconds)} seconds").dropDuplicatesWithinWatermark(list(keys))

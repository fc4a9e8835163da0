"""Claims of accepted events: a slim table that later batches are deduplicated against.

The table is bucketed by key, so a batch joins it without shuffling the claims. Each batch adds
one file per bucket. Every few batches the live claims are written anew, one per key, to the other of two
folders, whose former files that replaces: the number of files stays bounded, and
claims that can no longer block anything go. Which folder counts, and which batches, is told by
the commits of the store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.operators.dedupe import EVENT_KEYS, has_key, latest_claims
from hookloom.sources.commits import committed_place, manifests

COLUMNS = "source STRING, external_id STRING, received_at TIMESTAMP, batch_id BIGINT, attempt STRING"
TABLE = "claims"
FOLDERS = ("even", "odd")
# Batches that add files before live claims are written anew.
BATCHES_A_FOLDER = 16
BUCKETS = 8


class ClaimStore:
    """Claims under ``base``/claims; those over ``keep_seconds`` older than the latest arrival are dropped in time.

    The place that a commit names is ``folder/first batch/buckets``.
    """

    def __init__(
        self, spark: SparkSession, base: str, keep_seconds: float, buckets: int = BUCKETS, batches: int = BATCHES_A_FOLDER,
    ) -> None:
        self.spark, self.base, self.keep_seconds = spark, base.rstrip("/"), keep_seconds
        self.buckets, self.batches = buckets, batches

    def _table(self, folder: str, buckets: int) -> str:
        """Name of the folder's table in the session's catalog, declared over its files."""
        name = f"hookloom_claims_{hashlib.md5(f'{self.base}/{folder}/{buckets}'.encode()).hexdigest()}"
        location = f"{self.base}/{TABLE}/{folder}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY ({', '.join(EVENT_KEYS)}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def history(self) -> DataFrame | None:
        """Keys and arrivals of committed claims, None if there are none yet."""
        last = committed_place(self.spark, self.base, TABLE)
        if last is None:
            return None
        folder, first, buckets = last[1].split("/")
        # An attempt's claims count once it is committed. A folder holds a few batches.
        named = manifests(self.spark, self.base).filter(
            (F.col("table") == TABLE) & (F.col("place") == last[1]) & (F.col("batch_id") >= int(first))
        ).select("batch_id", "attempt").distinct()
        claims = self.spark.table(self._table(folder, int(buckets)))
        return claims.join(F.broadcast(named), ["batch_id", "attempt"], "left_semi").select(*EVENT_KEYS, "received_at")

    def add(self, events: DataFrame, batch_id: int, attempt: str) -> str:
        """Add the claims of accepted events and return the place that holds all live ones."""
        claims = events.filter(has_key(events, EVENT_KEYS) & F.col("received_at").isNotNull()).select(*EVENT_KEYS, "received_at")
        last = committed_place(self.spark, self.base, TABLE)
        place = f"{FOLDERS[0]}/{batch_id}/{self.buckets}"
        anew = last is None
        if last is not None:
            folder, first, buckets = last[1].split("/")
            anew = batch_id - int(first) >= self.batches or int(buckets) != self.buckets
            place = last[1]
            if anew:
                place = f"{FOLDERS[1 - FOLDERS.index(folder)]}/{batch_id}/{self.buckets}"
                every = self.history().unionByName(claims)
                newest = every.agg(F.max(F.unix_micros("received_at"))).first()[0]
                claims = latest_claims(every, EVENT_KEYS).filter(
                    F.col("claimed_us") > F.lit((newest or 0) - int(self.keep_seconds * 1e6))
                ).select(*EVENT_KEYS, F.timestamp_micros("claimed_us").alias("received_at"))
        # One file a bucket: rows are dealt as buckets are.
        dealt = claims.repartition(self.buckets, *EVENT_KEYS).select(
            *EVENT_KEYS, "received_at", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(attempt).alias("attempt")
        )
        dealt.write.insertInto(self._table(place.split("/")[0], self.buckets), overwrite=anew)
        return place

"""Landed batches of requests as a stream that keeps its offsets by batch.

Requests land in batches that are committed whole (see `commits`). What is streamed is the manifests, one
small file per batch: Spark keeps the offsets, ``max_batches`` bounds a micro-batch, and a micro-batch
then reads the folders that its manifests name, with any reader Spark has. Files of a batch that is still
being written, or of an attempt that failed, are never picked up, and once a micro-batch has been
ingested, its folders can be cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.schemas import REQUESTS
from hookloom.sources.commits import COMMITS, MANIFEST, write_batch
from hookloom.sources.sinks import stage_requests

TABLE = "requests"


def land_requests(requests: DataFrame, base: str, batch_id: int) -> bool:
    """Land a batch under ``base``; False if that batch has landed before."""
    def write(attempt: str) -> dict[str, None]:
        stage_requests(requests, f"{base}/{TABLE}", batch_id, attempt)
        return {TABLE: None}

    return write_batch(requests.sparkSession, base, batch_id, write)


def stream_landings(spark: SparkSession, base: str, max_batches: int | None = None) -> DataFrame:
    """Manifests of landed batches as a stream."""
    reader = spark.readStream.schema(MANIFEST)
    if max_batches is not None:
        reader = reader.option("maxFilesPerTrigger", max_batches)
    return reader.parquet(f"{base}/{COMMITS}").filter(F.col("table") == TABLE)


def _folders(base: str, landings: DataFrame) -> list[str]:
    named = landings.select("batch_id", "attempt").distinct().collect()
    return sorted(f"{base}/{TABLE}/batch_id={row.batch_id}/attempt={row.attempt}" for row in named)


def landed_requests(base: str, landings: DataFrame) -> DataFrame:
    """The requests of some manifests."""
    folders = _folders(base, landings)
    spark = landings.sparkSession
    return spark.read.schema(REQUESTS).parquet(*folders) if folders else spark.createDataFrame([], REQUESTS)


def clear_landed(base: str, landings: DataFrame) -> int:
    """Empty the folders of some manifests, whose requests have been ingested; their number."""
    folders = _folders(base, landings)
    empty = landings.sparkSession.createDataFrame([], REQUESTS).coalesce(1)
    for folder in folders:
        empty.write.mode("overwrite").parquet(folder)
    return len(folders)

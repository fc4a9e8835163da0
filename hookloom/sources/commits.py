"""Batches of several tables that readers see whole or not at all.

A batch writes each of its tables to a folder of its own attempt, and a manifest last, which names the
attempt. `sinks.read_table` shows rows of named attempts only, so what an attempt that failed between
its tables left behind is never read, and a batch that is run again after its commit
writes nothing. Manifests lie beside the tables, in ``commits``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"
MANIFEST = "table string, attempt string, place string, committed_at timestamp, batch_id long"


def manifests(spark: SparkSession, base: str) -> DataFrame | None:
    """What was committed under ``base``: a row per batch and table; None for a store without commits."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base.rstrip('/')}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def committed_place(spark: SparkSession, base: str, table: str) -> tuple[int, str] | None:
    """Last committed batch and the place its manifest names for ``table``."""
    found = manifests(spark, base)
    if found is None:
        return None
    last = found.filter(F.col("table") == table).agg(F.max(F.struct("batch_id", "place")).alias("last")).first()["last"]
    return None if last is None else (last["batch_id"], last["place"])


def is_committed(spark: SparkSession, base: str, batch_id: int) -> bool:
    found = manifests(spark, base)
    return found is not None and not found.filter(F.col("batch_id") == batch_id).isEmpty()


def commit(spark: SparkSession, base: str, batch_id: int, attempt: str, places: Mapping[str, str | None]) -> None:
    """Name the attempt that holds ``batch_id`` of each table; the last write of a batch."""
    now = datetime.now(timezone.utc)
    rows = [(table, attempt, place, now) for table, place in places.items()]
    manifest = spark.createDataFrame(rows, MANIFEST.rsplit(",", 1)[0]).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{COMMITS}/batch_id={batch_id}")


def write_batch(spark: SparkSession, base: str, batch_id: int, write: Callable[[str], Mapping[str, str | None]]) -> bool:
    """Run ``write(attempt)``, which writes all tables and names them, and commit; False if done before."""
    if is_committed(spark, base, batch_id):
        return False
    attempt = uuid.uuid4().hex
    commit(spark, base, batch_id, attempt, write(attempt))
    return True


def committed_only(rows: DataFrame, base: str, table: str) -> DataFrame:
    """``rows`` with ``batch_id`` and ``attempt``, of committed attempts; unchanged in a store without commits.

    Manifests hold a row per batch and join on columns that folders carry: while Spark finds them
    small enough to broadcast, folders of other attempts are not read.
    """
    found = manifests(rows.sparkSession, base)
    if found is None or not {"batch_id", "attempt"} <= set(rows.columns):
        return rows
    named = found.filter(F.col("table") == table).select("batch_id", "attempt").distinct()
    return rows.join(named, ["batch_id", "attempt"], "left_semi").select(*rows.columns)

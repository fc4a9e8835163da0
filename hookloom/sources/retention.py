"""Bounded history on disk: batches that fell out whole are dropped, only those at the edge are rewritten."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.operators.readback import EVENTS_PER_SOURCE, beyond_cutoff, trim_cutoffs
from hookloom.sources.commits import COMMITS, MANIFEST, committed_only, manifests
from hookloom.sources.sinks import FOLDER_COLUMNS, ID_INDEX, read_table


class Retained(NamedTuple):
    """Batches by what became of their folders."""

    untouched: list[int]
    rewritten: list[int]
    dropped: list[int]


def retain_newest(
    spark: SparkSession, base: str, table: str = "events", n: int = EVENTS_PER_SOURCE, group: Sequence[str] = ("source",),
    time: str = "stored_at", row_id: str = "id",
) -> Retained:
    """Keep the ``n`` newest rows of each group of a committed table.

    Cutoffs come from a quantile sketch and one count (`trim_cutoffs`); another count per batch tells which
    batches hold rows to keep, to drop, or both. Those with both are written anew without what falls
    out, as another attempt; then the manifests of all that changed name the new attempt, or none.
    Readers see each batch as it was or as it is to be. Old folders stay for readers under way: see `vacuum`.
    """
    rows = read_table(spark, f"{base}/{table}")
    group = list(group)
    cutoffs = trim_cutoffs(rows, n, group, time, row_id)
    marked = beyond_cutoff(rows, cutoffs, group, time, row_id)
    counts = marked.groupBy("batch_id").agg(F.count("*").alias("rows"), F.count_if("_beyond").alias("gone")).collect()
    untouched = sorted(row["batch_id"] for row in counts if row["gone"] == 0)
    dropped = sorted(row["batch_id"] for row in counts if row["gone"] == row["rows"])
    edge = sorted(row["batch_id"] for row in counts if 0 < row["gone"] < row["rows"])
    attempt = uuid.uuid4().hex
    if edge:
        folders = ["batch_id", "attempt", *(name for name in ("source",) if name in rows.columns)]
        # Folders of other batches are not read again.
        kept = beyond_cutoff(rows.filter(F.col("batch_id").isin(edge)), cutoffs, group, time, row_id)
        kept.filter(~F.col("_beyond")).drop("_beyond").withColumn("attempt", F.lit(attempt)).sortWithinPartitions(
            *folders, row_id
        ).write.options(**ID_INDEX).partitionBy(*folders).mode("append").parquet(f"{base}/{table}")
    changed = dict.fromkeys(edge, attempt) | dict.fromkeys(dropped, None)
    if changed:
        now = datetime.now(timezone.utc)
        named = manifests(spark, base).filter(F.col("batch_id").isin(list(changed))).collect()
        for batch_id, new in changed.items():
            own = [
                (row.table, new if row.table == table else row.attempt, row.place, now if row.table == table else row.committed_at)
                for row in named if row.batch_id == batch_id
            ]
            spark.createDataFrame(own, MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(
                f"{base}/{COMMITS}/batch_id={batch_id}"
            )
    return Retained(untouched, edge, dropped)


def vacuum(spark: SparkSession, base: str, table: str = "events") -> int:
    """Empty the folders of attempts that no manifest names, of batches that were committed; their number.

    For when no reader is left that began before they were replaced. Only folder names are looked at.
    """
    names = spark.read.parquet(f"{base}/{table}").select(
        *(F.col(name).cast(FOLDER_COLUMNS[name]).alias(name) for name in ("batch_id", "attempt"))
    ).distinct()
    committed = manifests(spark, base).select("batch_id").distinct()
    named = committed_only(names, base, table)
    left = names.join(committed, "batch_id", "left_semi").join(named, ["batch_id", "attempt"], "left_anti").collect()
    for row in left:
        folder = f"{base}/{table}/batch_id={row.batch_id}/attempt={row.attempt}"
        old: DataFrame = spark.read.parquet(folder)
        writer = spark.createDataFrame([], old.schema).coalesce(1).write.mode("overwrite")
        # Data files must stay at one level of folders.
        (writer.partitionBy("source") if "/source=" in old.inputFiles()[0] else writer).parquet(folder)
    return len(left)

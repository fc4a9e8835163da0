"""Event, outcome, dead-letter and landing tables.

A batch id makes a write repeatable: each one owns a folder and replaces it when the
batch is run again after a failure. With an ``attempt`` as well, the folder is that attempt's
own and counts once `commits.commit` names it, together with the batch's other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookloom.sources.commits import committed_only

MAX_RECORDS_PER_FILE = 2_000_000

# Shuffled bytes of the events that one task sorts, about; they take ten times as much in memory.
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SORT_BYTES = "16m"

# Event files carry a Bloom filter of their ids, sized by the rows there are, and lie in order of
# id, so that a lookup reads only the row groups that may hold an id.
ID_INDEX = {
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.adaptive.enabled#id": "true",
    "parquet.bloom.filter.max.bytes": str(4 << 20),
}


def _write(
    df: DataFrame, path: str, partition_by: tuple[str, ...], batch_id: int | None, attempt: str | None = None,
    **options: str,
) -> None:
    writer = df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if batch_id is None:
        writer.mode("append").parquet(path)
    else:
        folder = f"{path.rstrip('/')}/batch_id={batch_id}"
        writer.mode("overwrite").parquet(folder if attempt is None else f"{folder}/attempt={attempt}")


def write_events(
    events: DataFrame, path: str, batch_id: int | None = None, compact: bool = False, attempt: str | None = None,
    spread: bool = False,
) -> None:
    """Append events, partitioned by source.

    ``stored_at`` is set to the time of the write unless given. ``compact`` adds a
    shuffle for few large files; a source with many rows is spread over several tasks. ``spread``
    shuffles by id into tasks that each sort about `SORT_BYTES`; without it a task sorts its partition, which
    of a staged table may be a large file. Files are indexed by ``id`` (see `ID_INDEX`).
    """
    if "stored_at" not in events.columns:
        events = events.withColumn("stored_at", F.current_timestamp())
    if compact:
        events = events.hint("rebalance", "source")
    elif spread:
        events = events.hint("rebalance", "id")
    events = events.sortWithinPartitions("source", "id")
    conf = events.sparkSession.conf
    before = conf.get(ADVISORY, None)
    if spread:
        conf.set(ADVISORY, SORT_BYTES)
    try:
        _write(events, path, ("source",), batch_id, attempt, **ID_INDEX)
    finally:
        if spread:
            conf.unset(ADVISORY) if before is None else conf.set(ADVISORY, before)


def write_dead_letters(
    dead_letters: DataFrame, path: str, batch_id: int | None = None, attempt: str | None = None,
) -> None:
    _write(dead_letters, path, (), batch_id, attempt)


def write_outcomes(outcomes: DataFrame, path: str, batch_id: int | None = None, attempt: str | None = None) -> None:
    _write(outcomes, path, (), batch_id, attempt)


def stage_requests(
    requests: DataFrame, path: str, batch_id: int | None = None, attempt: str | None = None,
) -> None:
    """Durable landing of raw requests, to be read back with `read_requests`."""
    _write(requests, path, (), batch_id, attempt)


# Types of the columns that folders carry. Guessed from the names of folders, a source
# such as 007 would come back as 7.
FOLDER_COLUMNS = {"source": T.StringType(), "batch_id": T.LongType(), "attempt": T.StringType()}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written by this module, with its partition columns as they were written.

    In a store with commits, rows of committed batches only; which attempt wrote them is left out.
    """
    found = spark.read.parquet(path).schema if schema is None else schema
    fields = [T.StructField(f.name, FOLDER_COLUMNS.get(f.name, f.dataType)) for f in found]
    table = spark.read.schema(T.StructType(fields)).parquet(path)
    base, _, name = path.rstrip("/").rpartition("/")
    return committed_only(table, base, name).drop("attempt") if "attempt" in table.columns else table

"""Session settings every job of this package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings that change results, not just speed.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key are valid; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Rows of a lookup table may be shipped to every executor up to this size.
MAX_BROADCAST_BYTES = 32 << 20

# Bytes of a table's files that one task parses, about, and tasks that a split is spread over, at most.
SCAN_BYTES = 1 << 20
SCAN_TASKS = 32


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need and return the session."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    configured = tempfile.mkdtemp(prefix="hookloom-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Cuts the lineage in a way that survives lost executors, and lets later
    passes read only the columns they need.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/hookloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_scan(scan: DataFrame, size: int = SCAN_BYTES) -> DataFrame:
    """Spread a file scan over all cores and over tasks of about ``size`` bytes of its files.

    Parsing is bound by CPU, and a parsed row takes many times its size in a file, so the splits of a
    well compressed file would be tasks that last for hours. A split becomes `SCAN_TASKS` tasks at
    most, and a table whose splits are small and many enough is read as it is, without a shuffle. The
    size is that of the plan's statistics; no job is started. Only for plain scans: a plan with
    exchanges would be executed to count its partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    held = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(cores, min(-(-held // size), SCAN_TASKS * splits))
    return scan.repartition(tasks) if splits < tasks else scan


def localize_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame | None:
    """``df`` as a local table when its measured size is under ``limit``, else None."""
    size = df.select(
        F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()["bytes"]
    if size is not None and size > limit:
        return None
    # Through Arrow the rows become part of the plan, with a known size.
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)

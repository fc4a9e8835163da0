"""Webhook requests as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hookloom.schemas import REQUESTS


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Request table with the fixed schema. In JSON files `body` is base64 text."""
    return spark.read.format(fmt).schema(REQUESTS).options(**options).load(path)


def stream_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """Requests arriving as files; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(REQUESTS).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka_requests(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Requests from a Kafka topic whose value is the body and whose key is the source.

    Needs the Kafka connector package on the session. Message headers are the request
    headers; arrival is the record's time and the id its partition and offset.
    """
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )
    return records.selectExpr(
        "concat_ws('-', topic, partition, offset) AS request_id",
        "cast(key AS string) AS source",
        "map_from_entries(transform(array_distinct(transform(headers, h -> h.key)), "
        "k -> struct(k, cast(filter(headers, h -> h.key = k)[0].value AS string)))) AS headers",
        "cast(NULL AS string) AS query_version",
        "value AS body",
        "timestamp AS received_at",
    )

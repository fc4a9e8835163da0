"""Table schemas. `request_id`, `received_at` and `stored_at` make reruns and order repeatable."""

from __future__ import annotations

from pyspark.sql import types as T

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("query_version", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("received_at", T.TimestampType()),
])

SPECS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("type_header", T.StringType()),
    T.StructField("type_field", T.StringType()),
    T.StructField("type_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("external_id_path", T.StringType()),
    T.StructField("timestamp_path", T.StringType()),
    T.StructField("fields_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("signature_header", T.StringType()),
    T.StructField("signature_secret_env", T.StringType()),
    T.StructField("redact_raw", T.BooleanType()),
])

EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("data", T.MapType(T.StringType(), T.VariantType())),
    T.StructField("raw", T.VariantType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])

OUTCOMES = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])

FAILURES = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("failed_at", T.TimestampType()),
    T.StructField("payload", T.StringType()),
])

"""Small request tables for tests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from hookloom.schemas import REQUESTS

ARRIVAL = datetime(2024, 8, 1, 12, 0, 0, tzinfo=timezone.utc)


def utc(*parts) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def request(source, body, headers=None, version=None, received_at=ARRIVAL, request_id=None):
    if isinstance(body, (dict, list)):
        body = json.dumps(body)
    if isinstance(body, str):
        body = body.encode()
    return (request_id or f"r{abs(hash((source, body, version, str(headers), received_at)))}",
            source, headers, version, body, received_at)


def requests_table(spark, *rows):
    """Rows of `request`, numbered in order."""
    numbered = [(f"r{i:04d}", *row[1:]) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, REQUESTS)


def instant(value) -> datetime | None:
    """A collected timestamp, which comes in the machine's zone, as UTC."""
    return value if value is None else value.astimezone(timezone.utc)

"""Column rules for request headers, signatures, ids and retry delays."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_HEADER = "x-spec-version"
HMAC_BLOCK = 64


def header_value(headers: Column, lower_name: Column | str) -> Column:
    """Header looked up without regard to case; '' when absent."""
    name = F.lit(lower_name) if isinstance(lower_name, str) else lower_name
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def requested_version(headers: Column, query_version: Column) -> Column:
    """Version asked for by header, else by query parameter; NULL means the latest."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(header_value(headers, VERSION_HEADER), empty), F.nullif(query_version, empty)
    )


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key pads of a secret (RFC 2104)."""
    key = secret.encode()
    if len(key) > HMAC_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(inner_pad: Column, outer_pad: Column, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256, built from SHA-2 and binary concatenation."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def signature_hex(header: Column) -> Column:
    """Signature part of a header in any of the accepted forms; '' when there is none."""
    parts = F.transform(F.split(header, ","), lambda p: F.trim(p))
    listed = F.get(F.filter(parts, lambda p: p.startswith("v1=")), F.lit(0))
    raw_hex = (F.length(header) >= 32) & header.rlike(r"^([0-9a-fA-F]{2})+$")
    return (
        F.when(header.startswith("sha256="), F.substr(header, F.lit(8)))
        .when(header.startswith("v1="), F.substr(header, F.lit(4)))
        .when(header.contains(",v1="), F.substr(listed, F.lit(4)))
        .when(raw_hex, header)
        .otherwise("")
    )


def signature_problem(header: Column, secret_known: Column, expected: Column) -> Column:
    """Why a signature fails, NULL when it holds."""
    given = signature_hex(header)
    return (
        F.when(~secret_known, "secret not set")
        .when(header == "", "missing signature header")
        .when(given == "", "no signature in header")
        .when(~given.rlike(r"^([0-9a-fA-F]{2})+$"), "invalid signature hex")
        .when(F.lower(given) != expected, "signature mismatch")
    )


def derived_event_id(request_id: Column) -> Column:
    """UUID-shaped id that is the same on every attempt for one request."""
    digest = F.md5(request_id)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def retry_delay_seconds(base_seconds: float, attempt: Column) -> Column:
    return F.lit(float(base_seconds)) * F.pow(F.lit(2.0), attempt)

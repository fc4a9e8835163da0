"""Requests to classified, normalized rows: spec lookup, gates and field projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.functions import instants, payload as pl, requests as rq
from hookloom.operators.catalog import SpecLookup

MAX_BODY_BYTES = 1 << 20

# Answer status of every outcome.
STATUS = {
    "accepted": 202,
    "duplicate": 200,
    "missing_source": 400,
    "body_too_large": 400,
    "invalid_json": 400,
    "invalid_signature": 401,
    "spec_not_found": 404,
    "unserializable": 503,
}

EVENT_COLUMNS = (
    "id", "source", "version", "type", "external_id", "timestamp", "data", "raw",
    "request_id", "received_at",
)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns the optimizer may not copy into later filters and projections.

    A filter on a computed column is otherwise pushed below it by repeating its
    expression, which would parse every body again per use. Predicates do not pass
    a generator, so the row is run through one that yields exactly one row.
    """
    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def resolve_specs(requests: DataFrame, lookup: SpecLookup) -> DataFrame:
    """Attach the spec asked for by header or query, else the latest of the source.

    ``version`` is NULL where no spec matches.
    """
    asked = rq.requested_version(F.col("headers"), F.col("query_version"))
    r = requests.withColumn("_asked_version", asked)
    match = (r["source"] == lookup.table["_spec_source"]) & r["_asked_version"].eqNullSafe(
        lookup.table["_match_version"]
    )
    return r.join(lookup.table, match, "left").drop("_asked_version", "_match_version", "_spec_source")


def signature_reason() -> Column:
    """Reason a resolved request fails its spec's signature check, else NULL."""
    expected = rq.hmac_sha256(F.col("_inner_pad"), F.col("_outer_pad"), F.col("body"))
    header = rq.header_value(F.col("headers"), F.col("_signature_header"))
    return F.when(
        F.col("_signature_header").isNotNull(),
        rq.signature_problem(header, F.col("_inner_pad").isNotNull(), expected),
    )


def provider_type() -> Column:
    """Event type as the provider names it, from a header or the body; '' when missing."""
    from_body = pl.scalar_text(F.col("_type"), F.col("_type_kind"), general=True)
    from_header = rq.header_value(F.col("headers"), F.col("_type_header"))
    return F.coalesce(F.when(F.col("_type_header") != "", from_header).otherwise(from_body), F.lit(""))


def classify_requests(
    requests: DataFrame, lookup: SpecLookup, max_body: int = MAX_BODY_BYTES
) -> DataFrame:
    """One row per request: the normalized event and the first gate it fails.

    ``outcome`` is 'accepted' for everything that may enter deduplication. No
    shuffle is needed while the lookup is small enough to broadcast.
    """
    r = resolve_specs(requests, lookup)
    early = (
        F.when(F.coalesce("source", F.lit("")) == "", "missing_source")
        .when(F.octet_length("body") > max_body, "body_too_large")
        .when(F.col("version").isNull(), "spec_not_found")
    )
    r = computed_once(r, _early=early)
    # The signature is only worked out for requests that pass the cheaper gates.
    r = computed_once(r, _signature=F.when(F.col("_early").isNull(), signature_reason()))
    readable = F.col("_early").isNull() & F.col("_signature").isNull()
    r = r.withColumn("_text", F.when(readable, pl.body_text(F.col("body")))).drop("body")
    r = computed_once(r, _envelope=pl.parse_envelope(F.col("_text")))
    strict = pl.envelope_is_strict(F.col("_envelope"), F.col("_text"))
    r = computed_once(
        r, _strict=strict, _payload=F.when(strict, pl.envelope_payload(F.col("_envelope")))
    ).drop("_envelope", "_text")

    body = F.col("_payload")
    fields = ("_type", "_external", "_timestamp")
    r = computed_once(r, **{
        name: pl.value_at(body, F.col(f"{name}_path"), lookup.scalar_paths.get(f"{name}_path", ()))
        for name in fields
    })
    r = computed_once(r, **{f"{name}_kind": F.schema_of_variant(name) for name in fields})
    when = F.col("_timestamp")
    r = r.withColumns({
        "_provider_type": F.when(F.col("_strict"), provider_type()),
        "external_id": F.when(F.col("_strict"), F.coalesce(
            pl.scalar_text(F.col("_external"), F.col("_external_kind")), F.lit("")
        )),
    })
    r = computed_once(
        r, _time_text=F.when(F.col("_timestamp_kind") == "STRING", F.try_variant_get(when, "$", "string"))
    )
    # Small steps keep every generated method below the size the JVM compiles.
    r = computed_once(
        r,
        _calendar=instants.calendar_micros(F.col("_time_text")),
        _epoch=instants.epoch_number(when, F.col("_timestamp_kind"), F.col("_time_text")),
    )
    r = computed_once(r, _micros=F.coalesce("_calendar", instants.epoch_micros(F.col("_epoch"))))
    outcome = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_signature").isNotNull(), "invalid_signature")
        .when(~F.coalesce("_strict", F.lit(False)), "invalid_json")
        .when(~instants.is_writable(F.col("_micros")), "unserializable")
        .otherwise("accepted")
    )
    writable = instants.is_writable(F.col("_micros"))
    return r.select(
        rq.derived_event_id(F.col("request_id")).alias("id"),
        "source",
        "version",
        F.coalesce(F.try_element_at("_type_mapping", F.col("_provider_type")), "_provider_type").alias("type"),
        "external_id",
        F.when(F.col("_strict"), F.coalesce(
            F.timestamp_micros(F.when(writable, F.col("_micros"))), "received_at"
        )).alias("timestamp"),
        F.when(F.col("_strict"), lookup.data).alias("data"),
        F.when(~F.col("_redact_raw"), pl.without_null(body)).alias("raw"),
        "request_id",
        "received_at",
        "headers",
        outcome.alias("outcome"),
        F.when(F.col("_early").isNull(), F.col("_signature")).alias("reason"),
        F.when(outcome == "unserializable", F.col("_micros")).alias("timestamp_micros"),
    )


def normalize_requests(requests: DataFrame, lookup: SpecLookup, random_ids: bool = False) -> DataFrame:
    """Events of all requests that pass the gates, before deduplication.

    Ids derive from ``request_id`` so that a rerun gives the same rows; with
    ``random_ids`` every run draws new ones.
    """
    events = classify_requests(requests, lookup).filter(F.col("outcome") == "accepted")
    events = events.select(*EVENT_COLUMNS)
    return events.withColumn("id", F.uuid()) if random_ids else events


def outcome_status(outcome: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.try_element_at(codes, outcome)


def flatten_events(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed columns from ``data``: ``fields`` maps data keys to SQL types.

    A value that does not fit its type is NULL. 'json' gives the JSON text.
    """
    def typed(key: str, kind: str) -> Column:
        value = F.try_element_at("data", F.lit(key))
        if kind == "json":
            return F.to_json(value).alias(key)
        return F.try_variant_get(value, "$", kind).alias(key)

    fixed = [c for c in ("id", "source", "version", "type", "external_id", "timestamp") if c in events.columns]
    return events.select(*fixed, *[typed(k, t) for k, t in fields.items()])

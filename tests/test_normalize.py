"""Requests of every provider, gates in order, and catalogs."""

import json

import pytest
from pyspark.sql import functions as F

from hookloom.operators import catalog as cat
from hookloom.operators import normalize as nm
from hookloom.plans.ingest import ingest
from hookloom.schemas import SPECS
from hookloom.sources.catalog import load_spec_catalog
from tests.helpers import ARRIVAL, instant, request, requests_table, utc

T0, T1 = utc(2024, 7, 3, 9, 46, 40), utc(2024, 7, 3, 9, 48, 20)

# source, headers, body, type, external id, timestamp, some of the data
PROVIDERS = [
    ("shopify", {"X-Shopify-Topic": "orders/create"},
     {"id": 98765, "created_at": "2024-07-15T14:30:00Z", "total_price": "299.99",
      "customer": {"email": "jo@shop.test"}, "line_items": [{"title": "Mug", "quantity": 2}]},
     "order.created", "98765", utc(2024, 7, 15, 14, 30),
     {"order_id": 98765, "total": "299.99", "customer_email": "jo@shop.test",
      "line_items": [{"title": "Mug", "quantity": 2}]}),
    ("stripe", None,
     {"id": "evt_1", "type": "charge.succeeded", "created": 1720000000, "livemode": False,
      "request": {"idempotency_key": None},
      "data": {"object": {"id": "ch_1", "amount": 2000, "billing_details": {"address": {"city": "Rome"}},
                          "payment_method_details": {"card": {"last4": "4242"}},
                          "outcome": {"risk_score": 32}}}},
     "payment.charge_succeeded", "evt_1", T0,
     {"object_id": "ch_1", "amount": 2000, "billing_city": "Rome", "card_last4": "4242",
      "risk_score": 32, "livemode": False, "idempotency_key": None, "invoice": None}),
    ("github", {"x-github-event": "push"},
     {"ref": "refs/heads/main", "created": False, "repository": {"full_name": "o/r", "private": True},
      "head_commit": {"author": {"name": "Kim"}}},
     "repo.push", "", ARRIVAL,
     {"ref": "refs/heads/main", "created": False, "repository": "o/r", "repo_private": True,
      "head_commit_author": "Kim", "pr_title": None}),
    ("github", {"X-GitHub-Event": "pull_request"},
     {"number": 42, "pull_request": {"title": "Fix", "merged": False, "head": {"ref": "fix"}}},
     "repo.pull_request", "", ARRIVAL, {"number": 42, "pr_title": "Fix", "pr_merged": False, "pr_head_ref": "fix"}),
    ("slack", None,
     {"event_id": "Ev1", "event_time": 1720000000, "event": {"type": "message", "text": "hi", "channel": "C1"}},
     "chat.message", "Ev1", T0, {"text": "hi", "channel": "C1", "channel_name": None}),
    ("slack", None,
     {"event_id": "Ev2", "event_time": 1720000100,
      "event": {"type": "reaction_added", "reaction": "wave", "item": {"channel": "C9"}}},
     "chat.reaction_added", "Ev2", T1, {"reaction": "wave", "item_channel": "C9"}),
    ("jira", None,
     {"webhookEvent": "jira:issue_created", "timestamp": 1720000000000, "user": {"displayName": "Lee"},
      "issue": {"key": "PROJ-1", "fields": {"summary": "Bug", "status": {"name": "Open"}}}},
     "issue.created", "PROJ-1", T0, {"summary": "Bug", "status": "Open", "actor": "Lee"}),
    ("linear", None,
     {"action": "create", "type": "Issue",
      "data": {"id": "u-1", "updatedAt": "2024-07-15T10:00:00.000Z", "state": {"name": "Todo"}, "labels": [{"name": "x"}]}},
     "resource.created", "u-1", utc(2024, 7, 15, 10),
     {"state": "Todo", "resource_type": "Issue", "labels": [{"name": "x"}]}),
    ("pagerduty", None,
     {"event": {"id": "e1", "event_type": "incident.triggered", "occurred_at": "2024-07-15T03:00:00Z",
                "data": {"id": "PABC", "title": "Down", "service": {"summary": "API"}}}},
     "incident.triggered", "PABC", utc(2024, 7, 15, 3), {"title": "Down", "service_name": "API"}),
    ("sendgrid", None,
     {"event": "bounce", "sg_event_id": "sg-2", "timestamp": 1720000100, "reason": "550", "smtp-id": "<1>"},
     "email.bounced", "sg-2", T1, {"reason": "550", "smtp_id": "<1>"}),
    ("discord", None,
     {"type": 2, "id": "i-1", "timestamp": "2024-07-15T12:00:00Z", "data": {"name": "roll"},
      "member": {"user": {"username": "ann"}}},
     "interaction.application_command", "i-1", utc(2024, 7, 15, 12), {"command_name": "roll", "username": "ann"}),
    ("twilio", None,
     {"MessageSid": "SM1", "SmsStatus": "delivered", "From": "+1", "NumMedia": "0"},
     "sms.delivered", "SM1", ARRIVAL, {"from": "+1", "num_media": "0"}),
    ("twilio", None, {"SmsStatus": "completely.unknown"}, "completely.unknown", "", ARRIVAL, {"body": None}),
    ("sendgrid", None, {}, "", "", ARRIVAL, {"email": None}),
    ("sendgrid", None, "null", "", "", ARRIVAL, {"email": None}),
    ("shopify", None, {"id": True}, "", "true", ARRIVAL, {"order_id": True}),
]


def check_providers(spark, lookup):
    table = requests_table(spark, *[request(p[0], p[2], p[1]) for p in PROVIDERS])
    rows = nm.normalize_requests(table, lookup).withColumn("data", F.to_json("data")).withColumn(
        "raw", F.to_json("raw")).orderBy("request_id").collect()
    assert len(rows) == len(PROVIDERS)
    for row, (source, _, body, kind, external_id, when, data) in zip(rows, PROVIDERS):
        assert (row["source"], row["type"], row["external_id"]) == (source, kind, external_id)
        assert instant(row["timestamp"]) == when
        got = json.loads(row["data"])
        assert {k: got[k] for k in data} == data
        if isinstance(body, dict):
            assert json.loads(row["raw"]) == body
        else:
            assert row["raw"] is None


def test_every_provider(spark, lookup):
    check_providers(spark, lookup)


def test_paths_from_rows_give_the_same(spark, catalog):
    check_providers(spark, cat.compile_lookup(catalog, max_planned_fields=10))
    check_providers(spark, cat.compile_lookup(catalog, max_bytes=10))


def test_all_data_keys_are_present(spark, catalog, lookup):
    rows = nm.normalize_requests(requests_table(spark, request("jira", {})), lookup)
    keys = set(rows.select(F.map_keys("data")).first()[0])
    assert keys == set(catalog.filter("source = 'jira'").select(F.map_keys("fields_data")).first()[0])
    assert rows.select(F.map_values("data")).first()[0] == [None] * len(keys)


def test_ids_repeat_on_a_rerun_unless_random(spark, lookup):
    table = requests_table(spark, request("jira", {}), request("slack", {}))
    first = [r[0] for r in nm.normalize_requests(table, lookup).select("id").collect()]
    again = [r[0] for r in nm.normalize_requests(table, lookup).select("id").collect()]
    random = [r[0] for r in nm.normalize_requests(table, lookup, random_ids=True).select("id").collect()]
    assert first == again and len(set(first)) == 2 and not set(first) & set(random)


@pytest.fixture(scope="module")
def gated(spark, catalog):
    """A lookup with signed, redacted and versioned sources."""
    mail = catalog.filter("source = 'sendgrid'")
    signed = mail.withColumn("source", F.lit("signed")).withColumn("signature_header", F.lit("X-Sig"))
    no_secret = signed.withColumn("source", F.lit("unset")).withColumn("signature_secret_env", F.lit("UNSET"))
    signed = signed.withColumn("signature_secret_env", F.lit("SET"))
    redacted = mail.withColumn("source", F.lit("redacted")).withColumn("redact_raw", F.lit(True))
    old = mail.withColumn("source", F.lit("app")).withColumn("version", F.lit("10.0"))
    new = old.withColumn("version", F.lit("2.0"))
    all_specs = cat.merge_catalogs(catalog, signed, no_secret, redacted, old, new)
    return cat.compile_lookup(all_specs, {"SET": "s", "OTHER": "t"})


GATES = [
    (request("", "{}"), "missing_source", None),
    (request(None, "{}"), "missing_source", None),
    (request("", b"x" * (2**20 + 1)), "missing_source", None),
    (request("sendgrid", b"x" * (2**20 + 1)), "body_too_large", None),
    (request("nowhere", b"x" * (2**20 + 1)), "body_too_large", None),
    (request("sendgrid", b'{"a":"' + b"x" * (2**20 - 8) + b'"}'), "accepted", None),
    (request("nowhere", "not json"), "spec_not_found", None),
    (request("sendgrid", "{}", version="1999"), "spec_not_found", None),
    (request("signed", "not json"), "invalid_signature", "missing signature header"),
    (request("signed", "{}", {"x-sig": "sha256=00"}), "invalid_signature", "signature mismatch"),
    (request("unset", "{}", {"X-Sig": "sha256=00"}), "invalid_signature", "secret not set"),
    (request("sendgrid", "not json"), "invalid_json", None),
    (request("sendgrid", ""), "invalid_json", None),
    (request("sendgrid", "[{}]"), "invalid_json", None),
    (request("sendgrid", {"timestamp": 10**12, "sg_event_id": "a"}), "unserializable", None),
    (request("sendgrid", {"timestamp": 10**18, "sg_event_id": "a"}), "unserializable", None),
    (request("sendgrid", {"timestamp": 1720000000, "sg_event_id": "a"}), "accepted", None),
    (request("sendgrid", {"timestamp": 1720000000, "sg_event_id": "a"}), "duplicate", None),
    (request("sendgrid", {}), "accepted", None),
    (request("sendgrid", {}), "accepted", None),
]


@pytest.mark.parametrize("staged", [True, False])
def test_gates_in_order_and_key_release(spark, gated, staged):
    result = ingest(requests_table(spark, *[g[0] for g in GATES]), gated, staged=staged)
    got = result.outcomes.orderBy("request_id").select("outcome", "reason").collect()
    assert [tuple(r) for r in got] == [g[1:] for g in GATES]
    statuses = {r[0]: r[1] for r in result.outcomes.select("outcome", "status").distinct().collect()}
    assert statuses == {k: v for k, v in nm.STATUS.items()}
    assert result.events.count() == sum(g[1] == "accepted" for g in GATES)
    dead = result.dead_letters.select("external_id", "reason", "timestamp").collect()
    assert [r[0] for r in dead] == ["a", "a"] and all("out of range" in r[1] for r in dead)


def test_versions_and_redaction(spark, gated):
    table = requests_table(
        spark, request("app", {}), request("app", {}, version="10.0"),
        request("app", {}, {"x-spec-version": "10.0"}, "2.0"), request("redacted", {"email": "e"}),
    )
    rows = nm.normalize_requests(table, gated).orderBy("request_id").select(
        "version", F.col("raw").isNull(), F.to_json("data")).collect()
    assert [r[0] for r in rows] == ["2.0", "10.0", "10.0", "2024-01"]
    assert [r[1] for r in rows] == [False, False, False, True]
    assert json.loads(rows[3][2])["email"] == "e"


def test_builtin_catalog(catalog):
    got = {(r.source, r.version): (len(r.type_mapping), len(r.fields_data)) for r in catalog.collect()}
    assert got == {
        ("discord", "2024-01"): (5, 24), ("github", "2024-01"): (17, 64), ("github", "2025-01"): (19, 64),
        ("jira", "2024-01"): (15, 54), ("linear", "2024-01"): (3, 40), ("pagerduty", "2024-01"): (15, 34),
        ("sendgrid", "2024-01"): (11, 21), ("shopify", "2024-07"): (3, 4), ("slack", "2024-01"): (19, 26),
        ("stripe", "2024-01"): (31, 37), ("stripe", "2025-04"): (34, 37), ("twilio", "2024-01"): (9, 24),
    }
    assert cat.validate_specs(catalog).count() == 0
    coverage = cat.catalog_coverage(catalog).collect()
    assert len(coverage) == 10 and not any(r.without_mapping or r.without_data for r in coverage)


def test_reading_custom_specs(spark, catalog, tmp_path):
    (tmp_path / "a.yml").write_text(
        "source: shopify\nversion: 2024-07\ntype_field: kind\ntype_mapping:\n  1: one\nredact_raw: true\n"
        "fields:\n  external_id: ref\n  timestamp: ~\n  data: {x: a.b}\n")
    (tmp_path / "b.yml").write_text("source: mine\nversion: 2.10\ntype_header: X-T\n")
    (tmp_path / "note.txt").write_text("not a spec")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.yml").write_text("source: deep\nversion: 1\ntype_header: X-T\n")
    custom = load_spec_catalog(spark, str(tmp_path), recursive=False)
    assert {(r.source, r.version) for r in custom.collect()} == {("shopify", "2024-07"), ("mine", "2.10")}
    assert load_spec_catalog(spark, str(tmp_path)).count() == 3
    merged = cat.merge_catalogs(catalog, custom)
    assert merged.count() == 13
    # An override of the latest version also holds where no version is asked for.
    rows = nm.normalize_requests(
        requests_table(spark, request("shopify", {"ref": 5, "kind": 1, "a": {"b": [1]}})),
        cat.compile_lookup(merged),
    ).select("external_id", "type", F.to_json("data"), "raw").collect()
    assert [tuple(r) for r in rows] == [("5", "one", '{"x":[1]}', None)]


def test_rules_for_specs(spark):
    blank = dict.fromkeys(SPECS.names)
    rows = [
        {**blank, "source": "a", "version": "1", "type_field": "t"},
        {**blank, "version": "1", "type_field": "t"},
        {**blank, "source": "b", "type_field": "t"},
        {**blank, "source": "c", "version": "1"},
        {**blank, "source": "d", "version": "1", "type_field": "t", "type_header": "h", "signature_header": "s"},
    ]
    specs = spark.createDataFrame([tuple(r[c] for c in SPECS.names) for r in rows], SPECS)
    got = sorted((r.source or "", r.rule) for r in cat.validate_specs(specs).collect())
    assert got == [
        ("", "source is required"), ("b", "version is required"),
        ("c", "type_header or type_field is required"), ("d", "signature_header needs signature_secret_env"),
        ("d", "type_header and type_field exclude each other"),
    ]
    with pytest.raises(ValueError, match="required|exclude|needs"):
        cat.compile_lookup(specs)


def test_catalogs_with_repeats_or_unusable_paths_are_refused(spark, catalog):
    import pytest
    from pyspark.sql import functions as F

    from hookloom.operators import catalog as cat

    with pytest.raises(ValueError, match="times"):
        cat.compile_lookup(catalog.union(catalog))
    quoted = catalog.filter("source = 'stripe'").withColumn("external_id_path", F.lit("""a'b"c"""))
    with pytest.raises(ValueError, match="quotes"):
        cat.compile_lookup(quoted)


def test_a_spec_without_fields_gives_empty_data_on_every_path(spark, catalog):
    from pyspark.sql import functions as F

    from hookloom.operators import catalog as cat
    from hookloom.operators import normalize as nm
    from tests.helpers import request, requests_table

    none = catalog.filter("source = 'twilio'").withColumn("fields_data", F.lit(None).cast("map<string,string>"))
    rows = requests_table(spark, request("twilio", {"MessageSid": "m", "SmsStatus": "sent"}))
    for options in ({}, {"max_planned_fields": -1}, {"max_bytes": 1}):
        events = nm.normalize_requests(rows, cat.compile_lookup(none, **options))
        assert [dict(r.data) for r in events.select("data").collect()] == [{}], options

"""The registered queries as SQL over the base tables, without JSON or specs."""

from __future__ import annotations


def event_id(text: str) -> str:
    d = f"md5({text})"
    return (
        f"substr({d},1,8)||'-'||substr({d},9,4)||'-4'||substr({d},14,3)||'-'||"
        f"translate(substr({d},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({d},18,3)||'-'||"
        f"substr({d},21,12)"
    )


def claims(source: str, seconds: int, name: str = "claims", prefix: str = "src") -> str:
    """CTEs with the claims (k, t) of rows (k, t, ...) by definition: the first row, then
    again and again the first row a TTL after the last claim."""
    return f"""
    {prefix} AS ({source}),
    {name}(k, t) AS (
      SELECT k, min(t) FROM {prefix} GROUP BY k
      UNION ALL
      SELECT n.k, n.t FROM (
        SELECT c.k AS k, c.t AS was, min(s.t) AS t
        FROM {name} c JOIN {prefix} s ON s.k = c.k AND s.t >= c.t + to_seconds({seconds})
        GROUP BY c.k, c.t) n)"""


TTL_EVENTS = "SELECT event_type || '|' || user_id AS k, ts AS t, event_id FROM events"

MAIL_TYPE = """CASE event_type WHEN 'view' THEN 'email.opened' WHEN 'signup' THEN 'email.delivered'
  WHEN 'error' THEN 'email.bounced' WHEN 'purchase' THEN 'email.processed' ELSE 'email.clicked' END"""

PAY_VERSION = """CASE event_id % 5 WHEN 0 THEN '2024-01' WHEN 1 THEN '2025-04' WHEN 2 THEN '2024-01'
  WHEN 3 THEN '2025-04' END"""

PAY_TYPE = """CASE event_type WHEN 'purchase' THEN 'payment.charge_succeeded'
  WHEN 'error' THEN 'payment.charge_failed'
  WHEN 'signup' THEN CASE WHEN event_id % 5 IN (1, 3) THEN 'billing.alert_triggered'
    ELSE 'billing.alert.triggered' END
  ELSE event_type END"""

# Documents as requests: the gate each one fails, and its dedupe key.
BULK = """SELECT doc_id, text, lang,
  TIMESTAMP '1970-01-01' + to_seconds(doc_id + 1700000000) AS t,
  CASE WHEN doc_id % 17 = 2 THEN '' WHEN doc_id % 13 = 1 THEN 'unknown' ELSE 'shopify' END AS source,
  CASE WHEN doc_id % 17 = 2 THEN 'missing_source'
    WHEN doc_id % 13 = 1 OR doc_id % 23 = 8 THEN 'spec_not_found'
    WHEN doc_id % 7 = 3 OR doc_id % 11 = 5 THEN 'invalid_json'
    WHEN doc_id % 29 = 6 THEN 'accepted'
    WHEN doc_id % 19 = 4 THEN 'unserializable'
    ELSE 'accepted' END AS gate,
  CASE WHEN doc_id % 29 <> 6 THEN md5(text) END AS k
  FROM documents"""

BULK_OUTCOMES = f"""bulk AS ({BULK}),
  {claims("SELECT k, t FROM bulk WHERE gate = 'accepted' AND k IS NOT NULL", 86400)},
  outcomes AS (
    SELECT b.*, CASE WHEN gate = 'accepted' AND b.k IS NOT NULL AND c.k IS NULL THEN 'duplicate'
      ELSE gate END AS outcome
    FROM bulk b LEFT JOIN claims c ON c.k = b.k AND c.t = b.t)"""

STATUS = """CASE outcome WHEN 'accepted' THEN 202 WHEN 'duplicate' THEN 200 WHEN 'spec_not_found' THEN 404
  WHEN 'invalid_signature' THEN 401 WHEN 'unserializable' THEN 503 ELSE 400 END"""

IS_ERROR = "outcome NOT IN ('accepted', 'duplicate')"

MAIL_OUTCOMES = f"""{claims(TTL_EVENTS, 86400)},
  outcomes AS (
    SELECT e.*, CASE WHEN c.k IS NULL THEN 'duplicate' ELSE 'accepted' END AS outcome
    FROM events e LEFT JOIN claims c
      ON c.k = e.event_type || '|' || e.user_id AND c.t = e.ts)"""

STORED = """SELECT lpad(event_id::VARCHAR, 20, '0') AS id, event_type AS source,
  'user.' || (user_id % 7) AS type, 'u' || user_id AS external_id, ts, value FROM events"""

SPECS = """SELECT o.*, CASE WHEN o_orderkey % 101 = 7 THEN '' ELSE 'shop-' || o_custkey END AS source,
  CASE WHEN o_orderkey % 103 = 9 THEN '' ELSE o_orderkey || '.0' END AS version,
  CASE WHEN o_orderkey % 3 = 0 THEN 'X-Topic' ELSE '' END AS type_header,
  CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 15 = 0 THEN 'kind' ELSE '' END AS type_field,
  o_orderkey % 5 <> 2 AS mapped,
  o_orderkey % 4 = 1 AND o_orderkey % 8 <> 1 AS unsigned
  FROM orders o"""

SIGNED = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing signature header'
  WHEN event_id % 5 = 0 THEN 'signature mismatch' END AS reason FROM events"""

ATTEMPTS = f"""{claims("SELECT user_id AS k, ts AS t FROM events", 172800)},
  last_start AS (SELECT k, max(t) AS t FROM claims GROUP BY k),
  attempts AS (
    SELECT 'msg-' || e.user_id AS message_id, count(*) AS attempts, max(ts) AS failed_at,
      'source-' || (any_value(e.user_id) % 5) AS source,
      'store event: ' || arg_max(event_type, ts) AS error,
      arg_max(event_id, ts) % 4 <> 0 AS readable
    FROM events e JOIN last_start s ON s.k = e.user_id AND e.ts >= s.t GROUP BY e.user_id)"""

BOUNDS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0")

_OLD = "ts < TIMESTAMP '2024-01-16'"

ORACLES: dict[str, str] = {
    "normalize_shop_orders": f"""
        SELECT {event_id("'order-' || o_orderkey")} AS id, 'shopify' AS source, '2024-07' AS version,
          CASE o_orderstatus WHEN 'F' THEN 'order.created' WHEN 'O' THEN 'order.updated'
            ELSE 'orders/partially_fulfilled' END AS type,
          o_orderkey::VARCHAR AS external_id, o_orderdate AS "timestamp", o_orderkey AS order_id,
          o_totalprice::VARCHAR AS total, c_name AS customer_email, NULL::VARCHAR AS line_items
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "normalize_shop_line_items": """
        SELECT l_orderkey::VARCHAR AS external_id, l_partkey AS title, l_quantity AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "normalize_mail_timestamps": f"""
        SELECT {MAIL_TYPE} AS type, 'sg-' || event_id AS external_id,
          CASE WHEN event_id % 8 IN (0, 5, 7) THEN ts
            WHEN event_id % 8 = 4 THEN date_trunc('millisecond', ts)
            ELSE date_trunc('second', ts) END AS "timestamp",
          'user' || user_id || '@example.com' AS email, value AS attempt, props AS reason,
          '<' || event_id || '>' AS smtp_id
        FROM events""",
    "normalize_pay_nested": f"""
        SELECT {PAY_VERSION} AS version, {PAY_TYPE} AS type, 'evt_' || event_id AS external_id,
          date_trunc('second', ts) AS "timestamp", event_id AS amount, 'eur' AS currency,
          user_id AS customer, 'City ' || user_id AS billing_city, value AS risk_score,
          event_id % 2 = 0 AS livemode, NULL::VARCHAR AS card_brand
        FROM events WHERE {PAY_VERSION} IS NOT NULL""",
    "normalize_chat_messages": """
        SELECT CASE WHEN role = 'system' THEN 'team.member_joined' ELSE 'chat.message' END AS type,
          conv_id || '-' || turn AS external_id,
          TIMESTAMP '1970-01-01' + to_seconds(conv_id * 100 + turn + 1700000000) AS "timestamp",
          role AS "user", text, 'c' || conv_id AS channel_name,
          '{"name":"c' || conv_id || '"}' AS channel
        FROM conversations""",
    "normalize_issues": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'issue.created' WHEN 1 THEN 'issue.comment_created' ELSE 'user_created' END AS type,
          'EV-' || event_id AS external_id, date_trunc('millisecond', ts) AS "timestamp", props AS summary,
          event_type AS status, 'User ' || user_id AS assignee, user_id % 2 = 0 AS assignee_active, value AS votes
        FROM events""",
    "normalize_tasks": """
        SELECT CASE event_id % 4 WHEN 0 THEN 'resource.created' WHEN 1 THEN 'resource.updated'
            WHEN 2 THEN 'resource.deleted' ELSE 'restore' END AS type,
          'task-' || event_id AS external_id, date_trunc('millisecond', ts) AS "timestamp", event_id AS number,
          event_type AS state, '[{"name":"' || event_type || '"}]' AS labels, value AS estimate, 'Issue' AS resource_type
        FROM events""",
    "normalize_incidents": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'incident.triggered' WHEN 1 THEN 'incident.note_added'
            ELSE 'incident.workflow.started' END AS type,
          'inc-' || event_id AS external_id, date_trunc('second', ts) AS "timestamp", 'call-' || event_id AS event_id,
          user_id AS incident_number, event_type AS service_name
        FROM events""",
    "normalize_interactions": """
        SELECT CASE event_id % 8 WHEN 0 THEN 'interaction.ping' WHEN 1 THEN 'interaction.application_command'
            WHEN 2 THEN 'interaction.message_component' WHEN 3 THEN 'interaction.autocomplete' WHEN 4 THEN '6'
            WHEN 5 THEN '2.5' WHEN 6 THEN '1.2345675e+06' ELSE '1e-05' END AS type,
          event_id::VARCHAR AS external_id, ts AS "timestamp", event_type AS command_name, 'user' || user_id AS username
        FROM events""",
    "normalize_text_messages": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'sms.delivered' WHEN 1 THEN 'sms.failed' ELSE 'scheduled' END AS type,
          'SM' || event_id AS external_id, ts AS "timestamp", '+1' || user_id AS "from", props AS body, '0' AS num_media
        FROM events""",
    "normalize_repositories": """
        SELECT '2024-01' AS version, CASE page_id % 3 WHEN 0 THEN 'repo.push' WHEN 1 THEN 'sub_issues' ELSE 'gollum' END AS type,
          url AS compare, page_id AS sender_id
        FROM pages""",
    "scalar_text_forms": """
        WITH parts AS (
          SELECT (event_id + 1)::VARCHAR AS number, rtrim((event_id + 1)::VARCHAR, '0') AS digits,
            CASE event_id % 8 WHEN 0 THEN -20 WHEN 1 THEN -7 WHEN 2 THEN -5 WHEN 3 THEN 0 WHEN 4 THEN 3
              WHEN 5 THEN 9 WHEN 6 THEN 25 ELSE 300 END AS power
          FROM events),
        placed AS (
          SELECT digits, length(number) + power AS point, length(number) + power - 1 AS e FROM parts),
        forms AS (
          SELECT *, CASE WHEN point <= 0 THEN '0.' || repeat('0', (-point)::INT) || digits
              WHEN point >= length(digits) THEN rpad(digits, point::INT, '0')
              ELSE left(digits, point) || '.' || substr(digits, point + 1) END AS plain
          FROM placed)
        SELECT plain AS external_id,
          CASE WHEN plain IN ('1', '2', '3', '4', '5') THEN ['interaction.ping', 'interaction.application_command',
                'interaction.message_component', 'interaction.autocomplete', 'interaction.modal_submit'][plain::INT]
            WHEN (point >= length(digits) AND point < 19) OR (e >= -4 AND e < 6) THEN plain
            ELSE left(digits, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END
              || CASE WHEN e < 0 THEN 'e-' ELSE 'e+' END || lpad(abs(e)::VARCHAR, greatest(2, length(abs(e)::VARCHAR))::INT, '0')
            END AS type
        FROM forms""",
    "reprocess_shop": """
        SELECT o_orderkey::VARCHAR AS external_id, 'accepted' AS outcome,
          CASE o_orderstatus WHEN 'F' THEN 'order.created' WHEN 'O' THEN 'order.updated'
            ELSE 'orders/partially_fulfilled' END AS type
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "store_numeric_sources": """
        SELECT lpad((user_id % 20)::VARCHAR, 3, '0') AS source, count(*) AS events FROM events GROUP BY 1""",
    "merged_catalog_lookup": f"""
        SELECT 'stripe' AS source, {PAY_VERSION} AS version, count(*) AS events
        FROM events WHERE {PAY_VERSION} IS NOT NULL GROUP BY 2""",
    "stream_ingest_tables": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT 'outcomes' AS kind, outcome, count(*) AS entries FROM outcomes GROUP BY outcome
        UNION ALL SELECT 'dead_letters', outcome, count(*) FROM outcomes WHERE outcome = 'unserializable' GROUP BY outcome
        UNION ALL SELECT 'events', outcome, count(*) FROM outcomes WHERE outcome = 'accepted' GROUP BY outcome""",
    "read_landed_requests": """
        SELECT 'text-' || doc_id AS request_id, 'shopify' AS source, octet_length(encode(text)) AS body_bytes,
          TIMESTAMP '1970-01-01' + to_seconds(doc_id + 1700000000) AS received_at
        FROM documents""",
    "normalize_code_pages": """
        SELECT '2025-01' AS version,
          CASE page_id % 3 WHEN 0 THEN 'repo.push' WHEN 1 THEN 'repo.sub_issues' ELSE 'gollum' END AS type,
          '' AS external_id, TIMESTAMP '1970-01-01' + to_seconds(page_id + 1700000000) AS "timestamp",
          url AS compare, html AS head_commit_message, page_id AS sender_id
        FROM pages""",
    "resolve_versions": f"""
        SELECT 'pay-' || event_id AS request_id, 'stripe' AS source, {PAY_VERSION} AS version FROM events""",
    "type_passthrough_counts": f"""
        SELECT {PAY_VERSION} AS version, {PAY_TYPE} AS type, count(*) AS events FROM events
        WHERE {PAY_VERSION} IS NOT NULL GROUP BY 1, 2""",
    "redact_raw_check": f"""
        SELECT 'sendgrid' AS source, count(*) AS events, count(*) AS without_raw, count(*) AS with_data
        FROM events
        UNION ALL
        SELECT 'stripe', count(*), 0, count(*) FROM events WHERE {PAY_VERSION} IS NOT NULL""",
    "classify_outcomes": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT 'doc-' || doc_id AS request_id, source,
          CASE WHEN outcome NOT IN ('missing_source', 'spec_not_found') THEN '2024-07' END AS version,
          CASE WHEN outcome IN ('accepted', 'duplicate', 'unserializable')
            THEN 'documents/' || lang END AS type,
          outcome, ({STATUS})::INTEGER AS status,
          CASE WHEN outcome IN ('accepted', 'duplicate')
            THEN {event_id("'doc-' || doc_id")} END AS event_id
        FROM outcomes""",
    "body_size_gate": """
        SELECT CASE WHEN strlen(text) > 2000 THEN 'body_too_large' ELSE 'invalid_json' END AS outcome,
          400 AS status, count(*) AS requests
        FROM documents GROUP BY 1""",
    "json_gate": f"""
        SELECT 'doc-' || doc_id AS request_id, source FROM ({BULK}) WHERE gate = 'invalid_json'""",
    "signature_gate": f"""
        SELECT 'mail-' || event_id AS request_id,
          CASE WHEN reason IS NULL THEN 'accepted' ELSE 'invalid_signature' END AS outcome,
          CASE WHEN reason IS NULL THEN 202 ELSE 401 END AS status, reason
        FROM ({SIGNED})""",
    "unserializable_dead_letters": f"""
        SELECT 'doc-' || doc_id AS request_id, md5(text) AS external_id,
          'timestamp out of range: 1000000000000000000' AS reason
        FROM ({BULK}) WHERE gate = 'unserializable'""",
    "dedupe_ttl_events": f"""
        WITH RECURSIVE {claims(TTL_EVENTS, 86400)}
        SELECT s.event_id, c.k IS NOT NULL AS accepted
        FROM src s LEFT JOIN claims c ON c.k = s.k AND c.t = s.t""",
    "dedupe_ttl_hot_keys": f"""
        WITH RECURSIVE {claims("SELECT event_type AS k, ts AS t, event_id FROM events", 3600)}
        SELECT s.event_id, c.k IS NOT NULL AS accepted
        FROM src s LEFT JOIN claims c ON c.k = s.k AND c.t = s.t""",
    "dedupe_against_history": f"""
        WITH RECURSIVE {claims(TTL_EVENTS, 86400)}
        SELECT s.event_id, true AS accepted FROM src s JOIN claims c ON c.k = s.k AND c.t = s.t""",
    "drop_already_seen": f"""
        WITH last AS (SELECT event_type, user_id, max(ts) AS seen FROM events WHERE {_OLD} GROUP BY ALL)
        SELECT event_id FROM events e LEFT JOIN last l USING (event_type, user_id)
        WHERE NOT ({_OLD}) AND (seen IS NULL OR ts >= seen + INTERVAL 24 HOUR)""",
    "dedupe_empty_id_bypass": """
        SELECT CASE page_id % 3 WHEN 0 THEN 'repo.push' WHEN 1 THEN 'repo.sub_issues' ELSE 'gollum' END
          AS type, count(*) AS events FROM pages GROUP BY 1""",
    "ingest_mail": f"""
        WITH RECURSIVE {MAIL_OUTCOMES}
        SELECT 'mail-' || event_id AS request_id, {MAIL_TYPE} AS type, outcome,
          ({STATUS})::INTEGER AS status FROM outcomes""",
    "ingest_mail_events": f"""
        WITH RECURSIVE {MAIL_OUTCOMES}
        SELECT {event_id("'mail-' || event_id")} AS id, {MAIL_TYPE} AS type,
          'sg-' || event_type || '-' || user_id AS external_id,
          'user' || user_id || '@example.com' AS email
        FROM outcomes WHERE outcome = 'accepted'""",
    "store_events": f"""
        SELECT 'stripe' AS source, {PAY_TYPE} AS type, count(*) AS events, sum(event_id)::BIGINT AS amount
        FROM events WHERE {PAY_VERSION} IS NOT NULL GROUP BY 2""",
    "event_by_id": f"""
        WITH last AS (
          SELECT external_id AS id, arg_max(source, ts) AS source, arg_max(type, ts) AS type,
            max(ts) AS stored_at, arg_max(value, ts) AS value
          FROM ({STORED}) GROUP BY 1)
        SELECT 'u' || c_custkey AS id, source, type, stored_at, value
        FROM customer LEFT JOIN last ON id = 'u' || c_custkey""",
    "latest_events": f"""
        SELECT id, type, ts AS stored_at FROM ({STORED}) WHERE source = 'click'
        ORDER BY ts DESC, id DESC LIMIT 250""",
    "latest_events_per_source": f"""
        SELECT id, source, type FROM ({STORED})
        QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY ts DESC, id DESC) <= 40""",
    "trim_events": f"""
        SELECT id, source FROM ({STORED})
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) <= 1200""",
    "trim_queue": f"""
        SELECT id FROM ({STORED}) QUALIFY row_number() OVER (ORDER BY ts DESC, id DESC) <= 3000""",
    "replay_listing": f"""
        SELECT id, type, external_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp"
        FROM ({STORED}) WHERE source = 'purchase' ORDER BY ts DESC, id DESC LIMIT 100""",
    "skip_corrupt_entries": """
        SELECT 'source-' || (user_id % 5) AS source, count(*) FILTER (event_id % 4 <> 0) AS readable,
          count(*) FILTER (event_id % 4 = 0) AS skipped
        FROM events GROUP BY 1""",
    "parse_stored_entries": """
        SELECT event_id::VARCHAR AS failure_id, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k
        FROM events WHERE event_id % 4 <> 0""",
    "list_specs": f"SELECT source, version, type_header, type_field FROM ({SPECS})",
    "validate_specs": f"""
        SELECT source, version, rule FROM ({SPECS}) s, LATERAL (VALUES
          (source = '', 'source is required'), (version = '', 'version is required'),
          (type_header = '' AND type_field = '', 'type_header or type_field is required'),
          (type_header <> '' AND type_field <> '', 'type_header and type_field exclude each other'),
          (unsigned, 'signature_header needs signature_secret_env')) r(broken, rule)
        WHERE broken""",
    "latest_specs": f"""
        SELECT source, max(version) AS version, arg_max(type_header, version) AS type_header
        FROM ({SPECS}) GROUP BY source""",
    "catalog_coverage": f"""
        SELECT source, count(*) AS versions, count(*) FILTER (NOT mapped) AS without_mapping,
          0::BIGINT AS without_data, count(*) FILTER (mapped) AS mappings, count(*) AS data_fields
        FROM ({SPECS}) GROUP BY source""",
    "spec_types": f"""
        SELECT source, version, o_orderstatus AS provider_type, o_orderpriority AS type
        FROM ({SPECS}) WHERE mapped""",
    "merge_catalogs": f"""
        SELECT source, version,
          CASE WHEN mapped AND o_orderstatus = 'F' THEN 'X-Custom' ELSE type_header END AS type_header
        FROM ({SPECS}) WHERE source <> '' AND version <> ''""",
    "resolve_large_catalog": f"""
        WITH latest AS (
          SELECT source, max(version) AS version,
            arg_max(CASE WHEN mapped AND o_orderstatus = 'F' THEN o_orderpriority ELSE 'F' END, version) AS type
          FROM ({SPECS}) WHERE source <> '' AND version <> '' GROUP BY source)
        SELECT source, version, type, c_acctbal AS total
        FROM customer JOIN latest ON source = 'shop-' || c_custkey""",
    "metrics_by_source": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT source, count(*) AS requests, count(*) FILTER (outcome = 'accepted') AS events_ingested,
          count(*) FILTER (outcome = 'duplicate') AS events_deduplicated,
          0::BIGINT AS signature_failures, count(*) FILTER ({IS_ERROR}) AS ingest_errors
        FROM outcomes GROUP BY source""",
    "events_ingested": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT source, 'documents/' || lang AS type, count(*) AS events_ingested
        FROM outcomes WHERE outcome = 'accepted' GROUP BY 1, 2""",
    "ingest_errors": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT source, outcome AS error_type, count(*) AS ingest_errors
        FROM outcomes WHERE {IS_ERROR} GROUP BY 1, 2""",
    "events_deduplicated": f"""
        WITH RECURSIVE {BULK_OUTCOMES}
        SELECT source, count(*) FILTER (outcome = 'duplicate') AS events_deduplicated
        FROM outcomes GROUP BY 1""",
    "signature_failures": f"""
        SELECT 'signed-mail' AS source, count(reason) AS signature_failures FROM ({SIGNED})""",
    "events_stored": "SELECT event_type AS source, count(*) AS events_stored FROM events GROUP BY 1",
    "latency_histogram": " UNION ALL ".join(
        f"""SELECT event_type AS source, CASE WHEN user_id % 3 = 0 THEN 202 ELSE 200 END AS status,
          '{le}' AS le, count(*) FILTER (value / 100 <= {le}) AS requests FROM events GROUP BY 1, 2"""
        for le in BOUNDS
    ) + """ UNION ALL SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 202 ELSE 200 END, '+Inf',
          count(*) FROM events GROUP BY 1, 2""",
    "windowed_ingest_metrics": f"""
        WITH RECURSIVE {MAIL_OUTCOMES}
        SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, 'sendgrid' AS source, outcome,
          count(*) AS requests
        FROM outcomes GROUP BY 1, 3""",
    "backlog": f"SELECT id, source FROM ({STORED}) WHERE source = 'click' AND value <= 50",
    "attempt_counts": f"""
        WITH RECURSIVE {ATTEMPTS}
        SELECT message_id, attempts, failed_at, source, error FROM attempts""",
    "plan_retries": f"""
        WITH RECURSIVE {ATTEMPTS}
        SELECT message_id, attempts, CASE WHEN attempts < 3 THEN 'retry' ELSE 'dead_letter' END AS action,
          CASE WHEN attempts < 3 THEN pow(2, attempts) END AS delay_seconds,
          CASE WHEN attempts < 3 THEN failed_at + to_seconds(pow(2, attempts)) END AS due_at
        FROM attempts""",
    "dead_letters": f"""
        WITH RECURSIVE {ATTEMPTS}
        SELECT message_id, source, error AS reason, attempts::INTEGER AS attempts, readable, failed_at
        FROM attempts WHERE attempts >= 3""",
    "events_dead_lettered": f"""
        WITH RECURSIVE {ATTEMPTS}
        SELECT source, count(*) AS events_dead_lettered FROM attempts WHERE attempts >= 3 GROUP BY 1""",
    "events_retried": f"""
        WITH RECURSIVE {ATTEMPTS}
        SELECT source, sum(CASE WHEN attempts < 3 THEN attempts ELSE attempts - 1 END)::BIGINT
          AS events_retried FROM attempts GROUP BY 1""",
    "reprocess": f"""
        SELECT 'pay-' || event_id AS request_id, {PAY_VERSION} AS version,
          'payment.charge_failed' AS type,
          CASE WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'accepted' END AS outcome
        FROM events WHERE event_type = 'error' AND {PAY_VERSION} IS NOT NULL""",
    "stream_dedupe_ttl": """
        SELECT event_type, user_id, 1::BIGINT AS accepted, count(*) - 1 AS duplicates
        FROM events GROUP BY 1, 2""",
    "stream_dedupe_watermark": "SELECT DISTINCT event_type, user_id FROM events",
    "stream_ingest": """
        SELECT conv_id || '-' || turn AS external_id,
          CASE WHEN role = 'system' THEN 'team.member_joined' ELSE 'chat.message' END AS type,
          TIMESTAMP '1970-01-01' + to_seconds(conv_id * 100 + turn + 1700000000) AS "timestamp"
        FROM conversations""",
    "stream_retry_decisions": """
        SELECT 'msg-' || user_id AS message_id, count(*) - count(*) // 3 AS retries,
          count(*) // 3 AS dead_letters
        FROM events GROUP BY 1""",
    "stream_backlog": """
        SELECT event_id AS id, event_type AS source FROM events
        WHERE ts < TIMESTAMP '2024-01-16' AND (value IS NULL OR value > 50 OR user_id % 8 > 5)""",
    "latency_from_store": " UNION ALL ".join(
        f"""SELECT 'sendgrid' AS source, 202 AS status, '{le}' AS le,
          count(*) FILTER ((event_id * 7919 % 12000) / 1000 <= {bound}) AS requests, true AS p99_within_error FROM events"""
        for le, bound in [*((le, le) for le in BOUNDS), ("+Inf", 1e9)]
    ),
    "stream_redeliver": """
        WITH counted AS (
          SELECT 'msg-' || user_id AS message_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS early, count(*) AS n
          FROM events GROUP BY 1)
        SELECT message_id, early - early // 3 AS redelivered, n // 3 AS dead_letters
        FROM counted WHERE early > 0 OR n >= 3""",
}
ORACLES["retain_events"] = ORACLES["trim_events"]
ORACLES["stream_ingest_landings"] = ORACLES["stream_ingest"]

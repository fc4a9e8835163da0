"""Webhook requests built from the given tables, one set per provider shape.

Every row of a table becomes one request. Encodings and faults vary with the row's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.functions.requests import hmac_pads, hmac_sha256
from hookloom.schemas import REQUESTS
from hookloom.session import spread_scan

SIGNING_SECRET_NAME = "MAIL_WEBHOOK_SECRET"
SIGNING_SECRET = "a-secret-for-test-data"
SIGNED_SOURCE = "signed-mail"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table with its timestamps as instants; ``spread`` over all cores if it has few files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread:
        df = spread_scan(df)
    for field in df.schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _requests(
    rows: DataFrame, request_id: Column, source: Column | str, body: Column, received_at: Column,
    headers: Column | None = None, query_version: Column | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    no_headers = F.lit(None).cast("map<string,string>")
    return rows.select(
        request_id.cast("string").alias("request_id"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (no_headers if headers is None else headers).alias("headers"),
        (F.lit(None).cast("string") if query_version is None else query_version).alias("query_version"),
        body.cast("binary").alias("body"),
        received_at.alias("received_at"),
        *keep,
    ).select(*REQUESTS.names, *keep)


def shop_requests(spark: SparkSession, sf_dir: str, line_items: bool = False) -> DataFrame:
    """Orders as shop webhooks; the topic header follows the order status."""
    orders = table(spark, sf_dir, "orders", spread=True)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("o_totalprice").cast("string").alias("total_price"),
        F.struct(F.col("c_name").alias("email")).alias("customer"),
    ]
    if line_items:
        item = F.struct(F.col("l_partkey").alias("title"), F.col("l_quantity").alias("quantity"))
        items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.collect_list(item).alias("line_items")
        )
        rows = rows.join(items, "o_orderkey")
        parts.append(F.col("line_items"))
    topic = (
        F.when(F.col("o_orderstatus") == "F", "orders/create")
        .when(F.col("o_orderstatus") == "O", "orders/updated")
        .otherwise("orders/partially_fulfilled")
    )
    return _requests(
        rows, F.concat(F.lit("order-"), "o_orderkey"), "shopify", F.to_json(F.struct(*parts)),
        F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey)"),
        headers=F.create_map(F.lit("x-shopify-TOPIC"), topic),
    )


def mail_type(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", "open")
        .when(event_type == "signup", "delivered")
        .when(event_type == "error", "bounce")
        .when(event_type == "purchase", "processed")
        .otherwise(event_type)
    )


def mail_timestamp(ts: Column, event_id: Column) -> Column:
    """JSON text of a timestamp in one of eight encodings; the last is not accepted."""
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    micros = F.unix_micros(ts)
    kind = event_id % 8
    return (
        F.when(kind == 0, quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
        .when(kind == 1, quoted(F.concat(
            F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))))
        .when(kind == 2, quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")))
        .when(kind == 3, F.unix_seconds(ts).cast("string"))
        .when(kind == 4, F.unix_millis(ts).cast("string"))
        .when(kind == 5, quoted(micros.cast("string")))
        .when(kind == 6, quoted(F.concat(F.unix_seconds(ts), F.lit(".75"))))
        .otherwise(quoted(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    )


def mail_requests(spark: SparkSession, sf_dir: str, source: str = "sendgrid", shared_ids: bool = False) -> DataFrame:
    """Events as mail webhooks; with ``shared_ids`` a user's events of one type share an id."""
    rows = table(spark, sf_dir, "events", spread=True)
    external = (
        F.concat(F.lit("sg-"), "event_type", F.lit("-"), "user_id") if shared_ids
        else F.concat(F.lit("sg-"), "event_id")
    )
    fixed = F.to_json(F.struct(
        external.alias("sg_event_id"),
        mail_type(F.col("event_type")).alias("event"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("email"),
        F.col("value").alias("attempt"),
        F.col("props").alias("reason"),
        F.concat(F.lit("<"), "event_id", F.lit(">")).alias("smtp-id"),
    ))
    body = F.concat(
        F.regexp_replace(fixed, r"\}$", ""), F.lit(',"timestamp":'),
        mail_timestamp(F.col("ts"), F.col("event_id")), F.lit("}"),
    )
    return _requests(rows, F.concat(F.lit("mail-"), "event_id"), source, body, F.col("ts"), keep=("event_id",))


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail webhooks with signatures in all header forms; every fifth is altered, every eleventh has none."""
    rows = mail_requests(spark, sf_dir, SIGNED_SOURCE)
    inner, outer = hmac_pads(SIGNING_SECRET)
    good = hmac_sha256(F.lit(inner), F.lit(outer), F.col("body"))
    kind, altered = F.col("event_id") % 4, F.col("event_id") % 5 == 0
    digits = F.when(altered, F.translate(good, "0123456789abcdef", "fedcba9876543210")).otherwise(good)
    header = (
        F.when(kind == 0, F.concat(F.lit("sha256="), digits))
        .when(kind == 1, F.concat(F.lit("v1="), digits))
        .when(kind == 2, F.concat(F.lit("t=1700000000, v0=00,v1="), digits))
        .otherwise(F.upper(digits))
    )
    headers = F.when(F.col("event_id") % 11 != 0, F.create_map(F.lit("X-Mail-Signature"), header))
    return rows.withColumn("headers", headers)


def signed_spec(catalog: DataFrame) -> DataFrame:
    """The mail spec under another source, with a signature."""
    mail = catalog.filter(F.col("source") == "sendgrid")
    return (
        mail.withColumn("source", F.lit(SIGNED_SOURCE))
        .withColumn("signature_header", F.lit("X-Mail-Signature"))
        .withColumn("signature_secret_env", F.lit(SIGNING_SECRET_NAME))
    )


def pay_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payment webhooks with nested data.

    The version is asked for by header, by query, by both (the header counts), not at
    all, or is unknown, by the event's id.
    """
    rows = table(spark, sf_dir, "events", spread=True)
    kind = F.col("event_id") % 5
    header_version = F.when(kind == 0, "2024-01").when(kind == 1, "2025-04").when(kind == 2, "")
    query_version = (
        F.when(kind == 1, "2024-01").when(kind == 2, "2024-01").when(kind == 4, "2099-01")
    )
    pay_type = (
        F.when(F.col("event_type") == "purchase", "charge.succeeded")
        .when(F.col("event_type") == "error", "charge.failed")
        .when(F.col("event_type") == "signup", "billing.alert.triggered")
        .otherwise(F.col("event_type"))
    )
    body = F.to_json(F.struct(
        F.concat(F.lit("evt_"), "event_id").alias("id"),
        pay_type.alias("type"),
        F.unix_seconds("ts").alias("created"),
        (F.col("event_id") % 2 == 0).alias("livemode"),
        F.struct(F.struct(
            F.col("event_id").alias("amount"),
            F.lit("eur").alias("currency"),
            F.col("user_id").alias("customer"),
            F.struct(F.struct(F.concat(F.lit("City "), "user_id").alias("city")).alias("address"))
            .alias("billing_details"),
            F.struct(F.col("value").alias("risk_score")).alias("outcome"),
        ).alias("object")).alias("data"),
    ))
    return _requests(
        rows, F.concat(F.lit("pay-"), "event_id"), "stripe", body, F.col("ts"),
        headers=F.when(header_version.isNotNull(), F.create_map(F.lit("X-SPEC-Version"), header_version)),
        query_version=query_version, keep=("event_id",),
    )


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chat webhooks; whole texts travel in the body."""
    rows = table(spark, sf_dir, "conversations", spread=True)
    name = F.concat_ws("-", "conv_id", "turn")
    body = F.to_json(F.struct(
        name.alias("event_id"),
        (F.col("conv_id") * 100 + F.col("turn") + 1_700_000_000).alias("event_time"),
        F.lit("T1").alias("team_id"),
        F.struct(
            F.when(F.col("role") == "system", "team_join").otherwise("message").alias("type"),
            F.col("role").alias("user"),
            F.col("text").alias("text"),
            F.struct(F.concat(F.lit("c"), "conv_id").alias("name")).alias("channel"),
        ).alias("event"),
    ))
    arrival = F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn") + 1_700_000_060)
    return _requests(rows, F.concat(F.lit("chat-"), name), "slack", body, arrival)


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as code-host webhooks: type in a header, no external id, no timestamp."""
    rows = table(spark, sf_dir, "pages", spread=True)
    kind = (
        F.when(F.col("page_id") % 3 == 0, "push")
        .when(F.col("page_id") % 3 == 1, "sub_issues")
        .otherwise("gollum")
    )
    body = F.to_json(F.struct(
        F.col("url").alias("compare"),
        F.struct(F.col("html").alias("message")).alias("head_commit"),
        F.struct(F.col("page_id").alias("id")).alias("sender"),
    ))
    return _requests(
        rows, F.concat(F.lit("page-"), "page_id"), "github", body,
        F.timestamp_seconds(F.col("page_id") + 1_700_000_000),
        headers=F.create_map(F.lit("X-GITHUB-event"), kind),
    )


def _kind(*names: str) -> Column:
    """One of some names by the event's id."""
    choice = F.pmod("event_id", F.lit(len(names)))
    return F.element_at(F.array(*(F.lit(name) for name in names)), choice.cast("int") + 1)


def issue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issue tracker webhooks with milliseconds and deep fields."""
    body = F.to_json(F.struct(
        _kind("jira:issue_created", "comment_created", "user_created").alias("webhookEvent"),
        F.unix_millis("ts").alias("timestamp"),
        F.struct(
            F.col("event_id").alias("id"), F.concat(F.lit("EV-"), "event_id").alias("key"),
            F.struct(
                F.col("props").alias("summary"), F.struct(F.col("event_type").alias("name")).alias("status"),
                F.struct(
                    F.concat(F.lit("User "), "user_id").alias("displayName"),
                    (F.col("user_id") % 2 == 0).alias("active"),
                ).alias("assignee"),
                F.struct(F.col("value").alias("votes")).alias("votes"),
            ).alias("fields"),
        ).alias("issue"),
    ))
    return _event_webhooks(spark, sf_dir, "jira", body)


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task webhooks with a label array."""
    body = F.to_json(F.struct(
        _kind("create", "update", "remove", "restore").alias("action"),
        F.lit("Issue").alias("type"),
        F.struct(
            F.concat(F.lit("task-"), "event_id").alias("id"), F.col("event_id").alias("number"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updatedAt"),
            F.struct(F.col("event_type").alias("name")).alias("state"),
            F.array(F.struct(F.col("event_type").alias("name"))).alias("labels"),
            F.col("value").alias("estimate"),
        ).alias("data"),
    ))
    return _event_webhooks(spark, sf_dir, "linear", body)


def incident_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incident webhooks: type and time inside the event."""
    body = F.to_json(F.struct(F.struct(
        F.concat(F.lit("call-"), "event_id").alias("id"),
        _kind("incident.triggered", "incident.annotated", "incident.workflow.started").alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
        F.struct(
            F.concat(F.lit("inc-"), "event_id").alias("id"), F.col("user_id").alias("number"),
            F.struct(F.col("event_type").alias("summary")).alias("service"),
        ).alias("data"),
    ).alias("event")))
    return _event_webhooks(spark, sf_dir, "pagerduty", body)


def interaction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat interactions whose type is a number, whole or not."""
    kind = _kind("1", "2", "3.0", "4e0", "6", "2.5", "1234567.5", "0.00001")
    rest = F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.struct(F.struct(F.concat(F.lit("user"), "user_id").alias("username")).alias("user")).alias("member"),
        F.struct(F.col("event_type").alias("name")).alias("data"),
    ))
    body = F.concat(F.lit('{"type":'), kind, F.lit(","), F.substring(rest, 2, 1 << 30))
    return _event_webhooks(spark, sf_dir, "discord", body)


def text_message_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text message webhooks: flat, all text, without a time."""
    body = F.to_json(F.struct(
        F.concat(F.lit("SM"), "event_id").alias("MessageSid"),
        _kind("delivered", "failed", "scheduled").alias("SmsStatus"),
        F.concat(F.lit("+1"), "user_id").alias("From"), F.col("props").alias("Body"), F.lit("0").alias("NumMedia"),
    ))
    return _event_webhooks(spark, sf_dir, "twilio", body)


def scaled_value_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions whose id and type are numbers from 1e-20 to 1e300."""
    power = _kind("-20", "-7", "-5", "0", "3", "9", "25", "300")
    number = F.concat(F.col("event_id") + 1, F.lit("e"), power)
    body = F.concat(F.lit('{"id":'), number, F.lit(',"type":'), number, F.lit("}"))
    return _event_webhooks(spark, sf_dir, "discord", body)


def _event_webhooks(spark: SparkSession, sf_dir: str, source: str, body: Column) -> DataFrame:
    rows = table(spark, sf_dir, "events", spread=True)
    return _requests(
        rows, F.concat(F.lit(f"{source}-"), "event_id"), source, body, F.col("ts"), keep=("event_id",)
    )


def repository_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as code-host webhooks that ask for the older version."""
    return code_requests(spark, sf_dir).withColumn("query_version", F.lit("2024-01"))


def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shop webhooks with faults of every kind; copies of a text share an id."""
    rows = table(spark, sf_dir, "documents", spread=True)
    doc = F.col("doc_id")
    body = F.to_json(F.struct(
        F.md5("text").alias("id"),
        F.when(doc % 19 == 4, F.lit(10**18)).otherwise(doc + 1_700_000_000).alias("created_at"),
        F.col("n_chars").alias("total_price"),
        F.struct(F.col("lang").alias("email")).alias("customer"),
        F.col("text").alias("line_items"),
    ))
    body = (
        F.when(doc % 7 == 3, F.concat(body, F.lit("}")))
        .when(doc % 11 == 5, F.concat(F.lit("["), body, F.lit("]")))
        .when(doc % 29 == 6, F.lit("null"))
        .otherwise(body)
    )
    source = F.when(doc % 17 == 2, "").when(doc % 13 == 1, "unknown").otherwise("shopify")
    # Some ask for a version that does not exist.
    version = F.when(doc % 23 == 8, "1999-01")
    return _requests(
        rows, F.concat(F.lit("doc-"), "doc_id"), source, body, F.timestamp_seconds(doc + 1_700_000_000),
        headers=F.create_map(F.lit("X-Shopify-Topic"), F.concat(F.lit("documents/"), "lang")),
        query_version=version, keep=("doc_id",),
    )


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as bare text, for the size gate."""
    rows = table(spark, sf_dir, "documents", spread=True)
    return _requests(
        rows, F.concat(F.lit("text-"), "doc_id"), "shopify", F.col("text"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000), keep=("doc_id",),
    )


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec catalog with one row per order, some of them breaking rules."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(o % 101 == 7, "").otherwise(F.concat(F.lit("shop-"), "o_custkey")).alias("source"),
        F.when(o % 103 == 9, "").otherwise(F.concat("o_orderkey", F.lit(".0"))).alias("version"),
        F.when(o % 3 == 0, "X-Topic").otherwise("").alias("type_header"),
        F.when((o % 3 == 1) | (o % 15 == 0), "kind").otherwise("").alias("type_field"),
        F.when(o % 5 == 2, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.col("o_orderstatus"), F.col("o_orderpriority"))).alias("type_mapping"),
        F.lit("id").alias("external_id_path"),
        F.lit("").alias("timestamp_path"),
        F.create_map(F.lit("total"), F.lit("order.total")).alias("fields_data"),
        F.when(o % 4 == 1, "X-Signature").otherwise("").alias("signature_header"),
        F.when(o % 8 == 1, "SECRET").otherwise("").alias("signature_secret_env"),
        F.lit(False).alias("redact_raw"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a failed attempt of its user's message."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("failure_id"),
        F.concat(F.lit("msg-"), "user_id").alias("message_id"),
        F.concat(F.lit("source-"), F.col("user_id") % 5).alias("source"),
        F.concat(F.lit("store event: "), "event_type").alias("error"),
        F.col("ts").alias("failed_at"),
        F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("{"))).otherwise(F.col("props"))
        .alias("payload"),
    )


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored rows: source by event type, stored when they happened."""
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("user."), F.col("user_id") % 7).alias("type"),
        F.concat(F.lit("u"), "user_id").alias("external_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("value"),
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").alias("stored_at"),
    )

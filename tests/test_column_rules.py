"""Column rules against tables of inputs and expected values."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from hookloom.functions import instants
from hookloom.functions import payload as pl
from hookloom.functions import requests as rq
from tests.helpers import instant, utc

BODIES = {
    '{"a":1}': True, ' {"a":1}\n': True, "null": True, " null ": True, "{}": True,
    "[]": False, "3": False, '"s"': False, "": False, "  ": False, "nul": False, "true": False,
    '{"a":1} x': False, "{}{}": False, "{},{}": False, "{}],[{}": False, '{},"x"],[': False,
    "{'a':1}": False, '{"a":NaN}': False, '{"a":01}': False, '{"a":1,}': False, '{"a":"\n"}': False,
}


def test_only_one_object_or_null_is_a_body(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "body string")
    text = pl.body_text(F.col("body").cast("binary"))
    strict = pl.envelope_is_strict(pl.parse_envelope(text), text)
    got = {r[0]: r[1] for r in df.select("body", strict).collect()}
    assert got == BODIES
    parsed = {r[0] for r in df.filter(pl.strict_document(F.col("body")).isNotNull()).collect()}
    assert parsed == {b for b, ok in BODIES.items() if ok}


def test_repeated_key_keeps_last_value_and_bad_utf8_is_replaced(spark):
    df = spark.createDataFrame([(b'{"a":1,"a":2}',), (b'{"a":"\xff"}',)], "body binary")
    document = pl.strict_document(pl.body_text(F.col("body")))
    got = [r[0] for r in df.select(F.try_variant_get(document, "$.a", "string")).collect()]
    assert got == ["2", "�"]


PATHS = {
    "id": "7", "customer.email": "a@b.c", "customer.address.city": "Bern", "tags": '["x","y"]',
    "missing": None, "customer.missing": None, "tags.0": None, "customer.email.x": None,
    "smtp-id": "s", "none": None, "a.b": None, "quo'te": "q", "Customer.email": None, "": "empty",
}


@pytest.mark.parametrize("planned", [False, True])
def test_dot_paths(spark, planned):
    body = (
        '{"id":7,"customer":{"email":"a@b.c","address":{"city":"Bern"}},"tags":["x","y"],'
        '"smtp-id":"s","none":null,"a.b":1,"quo\'te":"q","":"empty"}'
    )
    df = spark.createDataFrame([(p, body) for p in PATHS], "path string, body string")
    df = df.withColumn("compiled", pl.compile_path(F.col("path")))
    known = [r[0] for r in df.select("compiled").collect()] if planned else []
    value = pl.without_null(pl.value_at(F.parse_json("body"), F.col("compiled"), known))
    got = {r[0]: r[1] for r in df.select("path", F.try_variant_get(value, "$", "string")).collect()}
    assert got == PATHS


SCALARS = [
    ('"abc"', "abc", "abc"), ("1", "1", "1"), ("1.0", "1", "1"), ("1e3", "1000", "1000"),
    ("1.5", "1.5", "1.5"), ("1.50", "1.5", "1.5"), ("-0.25", "-0.25", "-0.25"), ("true", "true", "true"),
    ("false", "false", "false"), ("null", None, None), ("98765", "98765", "98765"),
    ("12345678901234567890", "12345678901234567890", "12345678901234567890"),
    ("1e-7", "0.0000001", "1e-07"), ("0.00012", "0.00012", "0.00012"),
    ("1234567.5", "1234567.5", "1.2345675e+06"), ("0.00001234", "0.00001234", "1.234e-05"),
    ("9007199254740993", "9007199254740993", "9007199254740993"), ("[1]", "[1]", "[1]"), ("0", "0", "0"),
    ("100", "100", "100"), ("100.10", "100.1", "100.1"), ('""', "", ""),
]


def test_scalar_text(spark):
    df = spark.createDataFrame([(s[0],) for s in SCALARS], "json string").withColumn(
        "v", F.parse_json("json")
    )
    kind = F.schema_of_variant("v")
    got = df.select(
        "json", pl.scalar_text(F.col("v"), kind), pl.scalar_text(F.col("v"), kind, general=True)
    ).collect()
    assert [tuple(r) for r in got] == SCALARS


T0 = utc(2024, 7, 3, 9, 46, 40)
INSTANTS = [
    ('"1720000000"', T0), ('"1720000000.9"', T0), ("1720000000.9", T0), ("1720000000", T0),
    ("1720000000000", T0), ("1720000000000000", T0), ("1.72e9", T0), ('"+1720000000"', T0),
    ('"2024-07-01T14:00:00+02:00"', utc(2024, 7, 1, 12)), ('"2024-07-01T12:00:00"', utc(2024, 7, 1, 12)),
    ('"2024-07-01T12:00:00Z"', utc(2024, 7, 1, 12)), ('"2024-07-01T9:00:00Z"', utc(2024, 7, 1, 9)),
    ('"2024-07-01T12:00:00.123456789Z"', utc(2024, 7, 1, 12, 0, 0, 123456)),
    ('"2024-07-01T12:00:00,5-01:30"', utc(2024, 7, 1, 13, 30, 0, 500000)),
    ('"2024"', utc(1970, 1, 1, 0, 33, 44)), ("-1", utc(1969, 12, 31, 23, 59, 59)),
    ('"2024-07-01"', None), ('"2024-07-01 12:00:00"', None), ('"2024-07-01T12:00:00+0000"', None),
    ('"2024-02-30T12:00:00Z"', None), ('"2024-07-01t12:00:00Z"', None), ("true", None), ("[]", None),
    ("{}", None), ("null", None), ('"soon"', None), ('""', None), ('"1720000000 "', None),
]


def test_instants(spark):
    rows = [(j, ) for j, _ in INSTANTS]
    df = spark.createDataFrame(rows, "json string").withColumn("v", F.parse_json("json"))
    kind, text = F.schema_of_variant("v"), F.try_variant_get("v", "$", "string")
    text = F.when(kind == "STRING", text)
    micros = F.coalesce(
        instants.calendar_micros(text),
        instants.epoch_micros(instants.epoch_number(F.col("v"), kind, text)),
    )
    got = df.select("json", F.timestamp_micros(micros)).collect()
    assert [(r[0], instant(r[1])) for r in got] == INSTANTS


@pytest.mark.parametrize("json, writable", [
    ("253402300799", True), ("253402300800", False), ("1000000000000", False), ("-62167219200", True),
    ("-62167219201", False), ("1720000000000000000", False), ('"1e300"', False), ("-9e18", False),
    ('"99999999999999999999"', False), ("1000000000001", True),
])
def test_years_that_can_not_be_written(spark, json, writable):
    df = spark.createDataFrame([(json,)], "json string").withColumn("v", F.parse_json("json"))
    kind = F.schema_of_variant("v")
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    micros = instants.epoch_micros(instants.epoch_number(F.col("v"), kind, text))
    assert df.select(instants.is_writable(micros)).first()[0] is writable


BODY, SECRET = b'{"a":1}', "s3cret"
DIGEST = hmac.new(SECRET.encode(), BODY, hashlib.sha256).hexdigest()
SIGNATURES = [
    (f"sha256={DIGEST}", None), (f"v1={DIGEST}", None), (f"t=17,v1={DIGEST}", None),
    (f"t=17, v0=00 ,v1={DIGEST}", None), (DIGEST, None), (DIGEST.upper(), None),
    (f"sha256={DIGEST.upper()}", None), ("", "missing signature header"),
    ("ab" * 15, "no signature in header"), ("sha256=", "no signature in header"),
    ("zz" * 20, "no signature in header"), ("sha256=abc", "invalid signature hex"),
    ("v1=ab,v1=cd", "invalid signature hex"), (f"sha256={'0' * 64}", "signature mismatch"),
    ("0" * 64, "signature mismatch"), ("sha256=00", "signature mismatch"),
]


def test_signatures(spark):
    inner, outer = rq.hmac_pads(SECRET)
    df = spark.createDataFrame([(s[0],) for s in SIGNATURES], "header string")
    expected = rq.hmac_sha256(F.lit(inner), F.lit(outer), F.lit(BODY))
    problem = rq.signature_problem(F.col("header"), F.lit(True), expected)
    assert [tuple(r) for r in df.select("header", problem).collect()] == SIGNATURES
    unknown = rq.signature_problem(F.col("header"), F.lit(False), expected)
    assert {r[0] for r in df.select(unknown).collect()} == {"secret not set"}


@pytest.mark.parametrize("secret", ["k", "x" * 64, "y" * 65, "ü" * 50])
def test_hmac_equals_the_standard_one(spark, secret):
    inner, outer = rq.hmac_pads(secret)
    got = spark.range(1).select(rq.hmac_sha256(F.lit(inner), F.lit(outer), F.lit(BODY))).first()[0]
    assert got == hmac.new(secret.encode(), BODY, hashlib.sha256).hexdigest()


def test_headers_and_versions(spark):
    rows = [({"X-Spec-Version": "1"}, "2", "1"), ({"x-spec-VERSION": ""}, "2", "2"),
            ({}, "", None), (None, None, None), (None, "3", "3")]
    df = spark.createDataFrame(rows, "headers map<string,string>, q string, want string")
    asked = rq.requested_version(F.col("headers"), F.col("q"))
    assert all(r[0] == r[1] for r in df.select(asked, "want").collect())


def test_numbers_keep_all_their_digits(spark):
    from pyspark.sql import functions as F

    from hookloom.functions import payload as pl

    cases = {
        "1.5e-20": ("0.000000000000000000015", "1.5e-20"), "1e25": ("1" + "0" * 25, "1e+25"),
        "2.5e300": ("25" + "0" * 299, "2.5e+300"), "1.2345678901234567e-5": ("0.000012345678901234568", "1.2345678901234568e-05"),
        "8.41e21": ("8410000000000000000000", "8.41e+21"), "-1.5e-7": ("-0.00000015", "-1.5e-07"), "1e-4": ("0.0001", "0.0001"),
        "1.50": ("1.5", "1.5"), "-0.0": ("0", "0"), "0e5": ("0", "0"), "1234567.5": ("1234567.5", "1.2345675e+06"),
        "9007199254740993": ("9007199254740993",) * 2, "12345678901234567890123": ("12345678901234567890123",) * 2,
        "0.0000000000000000000000001": ("0.0000000000000000000000001", "1e-25"),
    }
    rows = spark.createDataFrame([(text,) for text in cases], "text string").withColumn("v", F.parse_json("text"))
    kind = F.schema_of_variant("v")
    got = rows.select("text", pl.scalar_text(F.col("v"), kind), pl.scalar_text(F.col("v"), kind, general=True)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases

"""Column rules for JSON bodies: strict parsing, dot paths and scalar text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def body_text(body: Column) -> Column:
    """Body bytes as text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def parse_envelope(text: Column) -> Column:
    """Parse the text as element 0 of an array that ends with the text's own digest.

    The JSON parser stops silently after the first value. Closing the array with a
    digest of the body makes trailing text visible with a single parse: a body can
    not contain its own digest, so only a lone JSON value leaves it at index 1.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def envelope_is_strict(envelope: Column, text: Column) -> Column:
    """True when the text is exactly one JSON object or the literal null."""
    lone_value = F.try_variant_get(envelope, "$[1]", "string").eqNullSafe(F.md5(text))
    return lone_value & text.rlike(r"^[ \t\n\r]*[{n]")


def envelope_payload(envelope: Column) -> Column:
    return F.try_variant_get(envelope, "$[0]", "variant")


def strict_document(text: Column) -> Column:
    """The parsed text, NULL unless it is exactly one JSON object or null."""
    return bound(
        parse_envelope(text),
        lambda envelope: F.when(envelope_is_strict(envelope, text), envelope_payload(envelope)),
    )


def compile_path(path: Column) -> Column:
    """Turn ``a.b`` into the variant path ``$['a']['b']``.

    Bracketed names never index arrays, so ``tags.0`` finds nothing.
    """
    def step(name: Column) -> Column:
        return F.when(name.contains("'"), F.concat(F.lit('["'), name, F.lit('"]'))).otherwise(
            F.concat(F.lit("['"), name, F.lit("']"))
        )

    steps = F.transform(F.split(path, r"\."), step)
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def value_at(payload: Column, path: Column, known: Sequence[str] = ()) -> Column:
    """Value at a compiled path, NULL when there is none.

    A literal path is parsed once per task, a path taken from a column once per row,
    so paths known when the plan is built get literal branches of their own.
    """
    value = F.try_variant_get(payload, path, "variant")
    if not known:
        return value
    branches = F
    for literal in known:
        branches = branches.when(path == literal, F.try_variant_get(payload, literal, "variant"))
    return branches.otherwise(value)


def without_null(value: Column) -> Column:
    """JSON null turned into SQL NULL."""
    return F.when(~F.is_variant_null(value), value)


def bound(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is worked out once however often ``result`` uses it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def shortest_text(number: Column) -> Column:
    """Text of a double with the fewest digits that give the same double again.

    The text of the runtime may carry a digit or two too many, so fewer are tried first.
    """
    tried = [F.format_string(f"%.{digits}e", number) for digits in (14, 15)]
    fitting = [F.when(text.try_cast("double") == number, F.upper(text)) for text in tried]
    return F.coalesce(*fitting, number.cast("string"))


def number_parts(text: Column) -> Column:
    """Sign, significant digits and place of the point of a number's text.

    The value is 0.digits times ten to the power of ``point``; zero has no digits.
    """
    mantissa = F.regexp_extract(text, r"^[-+]?([0-9.]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"E([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.translate(mantissa, ".", "")
    significant = F.regexp_replace(digits, "^0+", "")
    return F.struct(
        F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
        F.regexp_replace(significant, "0+$", "").alias("digits"),
        (F.length(F.regexp_extract(mantissa, "^[0-9]*", 0)) + power - F.length(digits) + F.length(significant))
        .alias("point"),
    )


def plain_number(parts: Column) -> Column:
    """Decimal digits without an exponent."""
    digits, point = parts["digits"], parts["point"]
    size = F.length(digits)
    return F.when(size == 0, "0").otherwise(F.concat(
        parts["sign"],
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size))),
    ))


def general_number(parts: Column) -> Column:
    """Like `plain_number`, but with an exponent of two digits or more below 1e-4 and from 1e6 on."""
    digits, power = parts["digits"], parts["point"] - 1
    exponent = F.concat(
        parts["sign"], F.regexp_replace(digits, "^(.)(.)", "$1.$2"), F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    small_or_large = (power < -4) | (power >= 6)
    return F.when((F.length(digits) > 0) & small_or_large, exponent).otherwise(plain_number(parts))


def scalar_text(value: Column, kind: Column, general: bool = False) -> Column:
    """Stable text of a variant scalar; NULL stays NULL, arrays and objects give JSON.

    ``kind`` is the variant's schema, computed before.

    Whole numbers print as digits. Other numbers print in plain decimal, or with
    ``general`` the way a general float format does. No digit is ever dropped, so
    different numbers have different texts.
    """
    as_double = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    whole = as_double.try_cast("bigint")
    number = general_number if general else plain_number

    def decimal(parts: Column) -> Column:
        is_whole = parts["point"] >= F.length(parts["digits"])
        return F.when(is_whole, plain_number(parts)).otherwise(number(parts))

    return (
        F.when(kind.isin("STRING", "BIGINT", "BOOLEAN"), text)
        .when((kind == "DOUBLE") & (whole == as_double), whole.cast("string"))
        .when(kind == "DOUBLE", bound(number_parts(shortest_text(as_double)), number))
        .when(kind.startswith("DECIMAL"), bound(number_parts(text), decimal))
        .when(kind != "VOID", F.to_json(value))
    )

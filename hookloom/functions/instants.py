"""Column rules for event timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms and the bounds that pick the epoch unit.
CALENDAR = r"^\d{4}-\d\d-\d\dT\d{1,2}:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(inf|infinity|nan)$"
MICROS_ABOVE = 10**15
MILLIS_ABOVE = 10**12

# Years 0 to 9999 can be written as JSON timestamps; in microseconds.
YEAR_0 = -62_167_219_200_000_000
YEAR_10000 = 253_402_300_800_000_000
# Stands for an epoch no timestamp can hold.
UNREPRESENTABLE = -(2**63)


def calendar_timestamp(text: Column) -> Column:
    """RFC 3339 text, or the same without an offset, taken as UTC. Else NULL.

    The text must match `CALENDAR`.
    """
    # Digits past the microsecond are cut; only such texts are this long.
    text = F.when(
        F.length(text) > 26, F.regexp_replace(text, r"([.,]\d{1,6})\d*", "$1")
    ).otherwise(text)
    text = F.translate(text, ",", ".")
    has_offset = text.endswith("Z") | F.substring(text, -6, 1).isin("+", "-")
    return F.when(has_offset, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def epoch_micros(epoch: Column) -> Column:
    """Microseconds of an integer epoch, with the unit guessed from its size."""
    return (
        F.when(epoch > MICROS_ABOVE, epoch)
        .when(epoch > MILLIS_ABOVE, epoch * 1000)
        .when(epoch >= -(9 * 10**12), epoch * 1_000_000)
        .when(epoch.isNotNull(), F.lit(UNREPRESENTABLE).cast("bigint"))
    )


def calendar_micros(text: Column) -> Column:
    return F.when(text.rlike(CALENDAR), F.unix_micros(calendar_timestamp(text)))


def epoch_number(value: Column, kind: Column, text: Column) -> Column:
    """Whole epoch named by a variant, fractions cut; NULL when it names none.

    ``kind`` is the variant's schema and ``text`` its string value, both computed before.
    """
    lost = F.lit(UNREPRESENTABLE).cast("bigint")
    return (
        F.when(
            (kind == "STRING") & text.rlike(NUMBER),
            F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), lost),
        )
        .when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(
            (kind == "DOUBLE") | kind.startswith("DECIMAL"),
            F.coalesce(F.try_variant_get(value, "$", "double").try_cast("bigint"), lost),
        )
    )


def is_writable(micros: Column) -> Column:
    return (micros >= YEAR_0) & (micros < YEAR_10000)

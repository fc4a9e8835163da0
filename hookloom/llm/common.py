"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.session import MAX_BROADCAST_BYTES

# ASCII white space as the corpus contracts count it.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

# A table may be broadcast up to this many rows, counted before the join, and up to as many bytes as any lookup.
BROADCAST_ROWS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` uses it.

    The optimizer may copy a column's definition into the lambda that uses it and so run it
    once per element; a lambda variable is never copied.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(text: Column) -> Column:
    """The text; none at all counts as empty."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def split_words(text: Column, separators: str = BLANK_RUN) -> Column:
    """Non-empty parts between runs of separators, in order."""
    return F.array_remove(F.split(text, separators), "")


def positions(count: Column) -> Column:
    """0 .. count - 1, empty for counts below one."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast when its counted rows and their measured bytes stay under the limits."""
    found = table.limit(rows + 1).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    ).first()
    return F.broadcast(table) if found["rows"] <= rows and (found["size"] or 0) <= size else table

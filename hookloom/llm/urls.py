"""URL filters: allow and block rules for hosts and path prefixes.

A URL is expanded into expressions, every suffix of its host (at label boundaries) with
every prefix of its path, and looked up by hash: an equi-join on the first 32 bits of the
expression's digest finds candidates, the full digest confirms them, and of the confirmed
rules the longest wins (at equal length the longer host, then a block). Only as many labels
and prefix lengths are expanded as rules have, which loses no match.

Defined cases: a null URL or one without ``://`` has an empty host and path. A URL that no
rule fits gets a null rule and the default verdict. Repeated rows get equal verdicts. The
rules may be empty; repeated rules count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.llm.common import broadcast_if_small, lower_ascii
from hookloom.session import stage_table

# The rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PREFIX_DIGITS = 8


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules with the digests of their expressions."""
    table = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    return table.select(
        rule.alias("rule"), "verdict", F.length("host").alias("host_chars"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("short"), digest.alias("digest"),
    ).distinct()


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Host suffixes of the given label counts, each with path prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.filter(F.array(*(
        F.when(F.size(parts) >= count, F.array_join(F.slice(parts, F.size(parts) - count + 1, F.lit(count)), "."))
        for count in labels
    )), lambda suffix: suffix.isNotNull())
    prefixes = F.filter(F.array(*(
        F.when(F.length(path) >= length, F.substring(path, 1, length)) for length in lengths
    )), lambda prefix: prefix.isNotNull())
    return F.flatten(F.transform(suffixes, lambda suffix: F.transform(
        prefixes, lambda prefix: F.concat(suffix, prefix)
    )))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, carry: Sequence[str] = ("page_id",),
    url: str = "url", default: str = "allow",
) -> DataFrame:
    """One row per page: the carried columns, ``host``, ``path``, ``rule`` and ``verdict``."""
    if any(not path.startswith("/") or verdict not in ("allow", "block") for verdict, _, path in rules):
        raise ValueError("a rule is allow or block, a host, and a path that starts with /")
    rows = pages.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"),
    )
    if not rules:
        return rows.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    labels = sorted({host.count(".") + 1 for _, host, _ in rules})
    lengths = sorted({len(path) for _, _, path in rules})
    table = broadcast_if_small(rule_table(pages, rules))
    asked = rows.select("host", "path").distinct().select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression")
    ).withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    confirmed = asked.join(table, "short").filter(F.col("full") == F.col("digest"))
    rank = F.struct(F.length("rule"), "host_chars", (F.col("verdict") == "block"))
    verdicts = confirmed.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), rank).alias("found")
    )
    verdicts = broadcast_if_small(stage_table(verdicts, "url-verdicts"))
    return rows.join(verdicts, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


_SQL_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)

OP2_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_SQL_RULES}),
parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
best AS (
    SELECT host, path, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict
    FROM (
        SELECT p.host, p.path, r.host || r.path AS rule, r.verdict, length(r.host || r.path) AS size
        FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    ) GROUP BY host, path
)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

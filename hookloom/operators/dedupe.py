"""Exact keyed deduplication with a time to live.

The first arrival claims its key for the TTL. Repeats inside it are duplicates and do
not extend it; the first arrival at or after its end claims anew. Whether a row claims
thus depends on the last claim, not on the row before.

Only keys and times are shuffled, never payloads:

1. count and time span per key, combined before the shuffle;
2. keys seen once need nothing more. A key whose rows all lie inside one TTL has one
   claim, its first row: decided by that aggregate;
3. other keys are walked in time order, a partition of keys per task;
4. a hot key among those is first cut into range partitions and thinned to the rows a
   chain of claims can reach, which leaves the result unchanged. With staging it is then
   decided in slices of time by a parallel prefix: each slice maps when the key is free on
   entry to when it is free on leaving, maps of neighbours are composed pairwise, and each
   slice, told its entry, marks its rows alone. A key whose rows repeat periodically, which
   thinning can not reduce, is thus spread over as many tasks as it has slices.

The ids of duplicates, usually few, are then joined to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookloom.functions.claims import claim_marker, compose_maps, offset_thinner, slice_maps, slice_marker, time_thinner
from hookloom.session import stage_table

DAY = 24 * 3600
EVENT_KEYS = ("source", "external_id")
# A key with more rows than this is cut into slices before it is walked.
HOT_ROWS = 1_000_000


def has_key(df: DataFrame, keys: Sequence[str]) -> Column:
    """False for rows without a usable key, which are never duplicates."""
    usable = F.lit(True)
    for key in keys:
        usable &= F.col(key).isNotNull()
        if isinstance(df.schema[key].dataType, T.StringType):
            usable &= F.col(key) != ""
    return usable


def latest_claims(history: DataFrame, keys: Sequence[str], time: str = "received_at") -> DataFrame:
    """Last claim per key of earlier runs, as keys and `claimed_us`."""
    return (
        history.filter(has_key(history, keys))
        .groupBy(*keys)
        .agg(F.max(F.unix_micros(time)).alias("claimed_us"))
    )


def _still_claimed(rows: DataFrame, claims: DataFrame, keys: Sequence[str], ttl_us: int, how: str) -> DataFrame:
    match = F.col("us") < F.col("claimed_us") + ttl_us
    for key in keys:
        match &= rows[key] == claims[key]
    return rows.join(claims, match, how)


def drop_already_seen(
    rows: DataFrame, history: DataFrame, keys: Sequence[str] = EVENT_KEYS,
    ttl_seconds: float = DAY, time: str = "received_at",
) -> DataFrame:
    """Rows whose key has no live claim in ``history``."""
    timed = rows.withColumn("us", F.unix_micros(time))
    claims = latest_claims(history, keys, time)
    return _still_claimed(timed, claims, keys, int(ttl_seconds * 1e6), "left_anti").drop("us")


def ttl_duplicates(
    rows: DataFrame,
    keys: Sequence[str] = EVENT_KEYS,
    ttl_seconds: float = DAY,
    time: str = "received_at",
    row_id: str = "request_id",
    history: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ids of the rows that are duplicates, as `request_id`.

    ``row_id`` must be unique; it also breaks ties of time. Rows without a time claim nothing
    and are no duplicates. ``history`` holds rows
    accepted by earlier runs. ``rows`` is read more than once, with only its keys, time
    and id: give it a written table when it is costly to compute. ``stage`` writes a table
    and reads it back; with it the rows of repeated keys are found once, not once for each
    way of deciding them.
    """
    keys = list(keys)
    ttl_us = int(ttl_seconds * 1_000_000)
    slim = rows.filter(has_key(rows, keys) & F.col(time).isNotNull()).select(
        *keys, F.unix_micros(time).alias("us"), F.col(row_id).alias("request_id")
    )
    found = []
    if history is not None:
        claims = latest_claims(history, keys, time)
        found.append(_still_claimed(slim, claims, keys, ttl_us, "left_semi").select("request_id"))
        slim = _still_claimed(slim, claims, keys, ttl_us, "left_anti")

    repeated = (
        slim.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("us", "request_id")).alias("first"),
            F.max("us").alias("last_us"),
        )
        .filter("n > 1")
    )
    single_claim = F.col("last_us") < F.col("first.us") + ttl_us
    # A hot key's side of this join is split by adaptive execution.
    routed = slim.join(
        repeated.select(*keys, "n", "first", single_claim.alias("single_claim")), keys
    )
    if stage is not None:
        routed = stage(routed)
    found.append(
        routed.filter(F.col("single_claim") & (F.col("request_id") != F.col("first.request_id")))
        .select("request_id")
    )
    walked = routed.filter(~F.col("single_claim"))
    row = [*keys, "us", "request_id"]
    found.append(
        _claims(walked.filter(F.col("n") <= hot_rows).select(*row), keys, ttl_us)
        .filter(~F.col("claimed"))
        .select("request_id")
    )
    hot = walked.filter(F.col("n") > hot_rows).select(*row)
    if stage is None or not hot.isEmpty():
        thinned = _thinned_by_offset(hot, keys, ttl_us)
        if stage is None:
            hot_claims = _claims(_thinned_by_time(thinned, keys, ttl_us), keys, ttl_us).filter("claimed")
        else:
            hot_claims = sliced_claims(thinned, keys, ttl_us)
        found.append(hot.join(hot_claims, "request_id", "left_anti").select("request_id"))

    duplicates = found[0]
    for more in found[1:]:
        duplicates = duplicates.unionByName(more)
    return duplicates


def _claims(slim: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "us", "request_id")
    return ordered.mapInPandas(claim_marker(keys, ttl_us), "request_id string, claimed boolean")


def _thinned_by_offset(slim: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """The rows of hot keys a chain of claims can reach, as far as slices by offset within the TTL tell.

    Range partitions hold even shares of the rows however they are spread over keys, also where
    very many rows share an offset: these are cut by bucket, which leaves each slice a range of
    offsets in every bucket. Rows at the same instant are one claim at most: the first id stays.
    """
    one_per_instant = slim.groupBy(*keys, "us").agg(F.min("request_id").alias("request_id"))
    bucketed = one_per_instant.withColumn("offset", F.pmod("us", F.lit(ttl_us))).withColumn(
        "bucket", F.expr(f"(us - offset) div {ttl_us}L")
    )
    return (
        bucketed.repartitionByRange(*keys, "offset", "bucket")
        .sortWithinPartitions(*keys, "bucket", "offset")
        .mapInPandas(offset_thinner(keys, ttl_us), bucketed.schema)
        .select(*keys, "us", "request_id")
    )


def _thinned_by_time(slim: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """The same as far as slices of time tell, which thin keys that go on for many TTLs."""
    return (
        slim.repartitionByRange(*keys, "us")
        .sortWithinPartitions(*keys, "us")
        .mapInPandas(time_thinner(keys, ttl_us), slim.schema)
    )


def sliced_claims(rows: DataFrame, keys: Sequence[str], ttl_us: int) -> DataFrame:
    """Ids of the claims among ``rows`` (keys, ``us``, ``request_id``; one row per key and instant).

    No task sees more than a slice, a range partition of one key. The tables of the
    rounds, whose number is the logarithm of a key's slices, go to the shared folder.
    """
    keys = list(keys)
    ends = rows.repartitionByRange(*keys, "us").withColumn("slice", F.spark_partition_id())
    slices = stage_table(ends, "claim-slices")
    ordered = slices.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice", "us")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"`{key}` {types[key]}" for key in keys)
    schema = f"{named}, node int, begins long, upto long, leaves long"
    maps = stage_table(ordered.mapInPandas(slice_maps(keys, ttl_us), schema.replace("node", "slice")), "claim-maps")
    # Slices of a key, at most one a partition, numbered in order of time.
    position = Window.partitionBy(*keys).orderBy("slice")
    numbered = maps.select(*keys, "slice").distinct().withColumn("node", F.row_number().over(position) - 1)
    numbered = stage_table(numbered, "claim-nodes")
    level = maps.join(numbered, [*keys, "slice"]).select(*keys, "node", "begins", "upto", "leaves")
    most = numbered.agg(F.max("node")).first()[0]
    levels = []
    while most is not None and most > 0:
        level = stage_table(level, "claim-level") if levels else level
        levels.append((level, most))
        halves = level.withColumn("half", F.col("node") % 2).withColumn("node", F.expr("node div 2").cast("int"))
        level = halves.repartition(*keys, "node").sortWithinPartitions(*keys, "node", "half", "upto").mapInPandas(
            compose_maps(keys, ttl_us), schema
        )
        most //= 2
    # From the whole key's entry down to that of each slice.
    entries = numbered.select(*keys).distinct().select(*keys, F.lit(0).alias("node"), F.lit(-(2**62)).alias("entry"))
    for level, _ in reversed(levels):
        entries = stage_table(entries, "claim-entries")
        here = entries.select(*keys, (F.col("node") * 2).alias("node"), "entry")
        passed = here.join(level, [*keys, "node"]).groupBy(*keys, "node", "entry").agg(
            F.min(F.when(F.col("upto") >= F.col("entry"), F.struct("upto", "leaves"))).alias("step")
        )
        after = passed.select(*keys, (F.col("node") + 1).alias("node"), F.coalesce("step.leaves", "entry").alias("entry"))
        # The last node of a level may have no right neighbour.
        there = level.select(*keys, "node").distinct()
        entries = here.unionByName(after.join(there, [*keys, "node"], "left_semi"))
    told = entries.join(numbered, [*keys, "node"]).select(*keys, "slice", "entry")
    marked = slices.join(told, [*keys, "slice"])
    return marked.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice", "us").mapInPandas(
        slice_marker(keys, ttl_us), "request_id string"
    )


def mark_duplicates(rows: DataFrame, duplicates: DataFrame, row_id: str = "request_id") -> DataFrame:
    """Add boolean `accepted` from the ids of duplicates."""
    marked = duplicates.select(F.col("request_id").alias(row_id), F.lit(True).alias("_duplicate"))
    joined = rows.join(marked, row_id, "left")
    return joined.select(*rows.columns, F.col("_duplicate").isNull().alias("accepted"))


def dedupe_ttl(rows: DataFrame, **options) -> DataFrame:
    """``rows`` with boolean `accepted`; options as for `ttl_duplicates`."""
    row_id = options.get("row_id", "request_id")
    return mark_duplicates(rows, ttl_duplicates(rows, **options), row_id)

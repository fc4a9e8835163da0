"""Reading stored events back, listing, and keeping bounded history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from hookloom.functions.payload import strict_document
from hookloom.operators.normalize import computed_once
from hookloom.session import stage_table

# Rows kept per source, in the queue and in the dead-letter table.
EVENTS_PER_SOURCE = 100_000
QUEUE_LENGTH = 1_000_000
DEAD_LETTERS = 10_000

# Ids that are looked up one by one.
INLINE_IDS = 64
# Size of the quantile sketch that brackets a cutoff to about one percent of a group's rows.
SKETCH_SIZE = 4096
# Quantiles read off a sketch.
SKETCH_STEPS = 512
# Before and after all instants, in microseconds. Rows without a time are the oldest.
OLDEST, NEWEST = -(2**63), 2**63 - 1


def rows_with_ids(events: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of some ids. Each equality reaches the files, whose Bloom filters then rule out most row groups."""
    wanted = F.lit(False)
    for one in ids:
        wanted = wanted | (F.col("id") == F.lit(one))
    return events.filter(wanted)


def event_by_id(events: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per id in ``ids``; the last stored wins, an unknown id has NULL columns.

    Up to `INLINE_IDS` ids are looked up by the index of the event files; more of them are
    joined, as a scan then is cheaper than as many comparisons per row.
    """
    wanted = ids.select("id").distinct()
    rest = [c for c in events.columns if c != "id"]
    few = [row["id"] for row in wanted.limit(INLINE_IDS + 1).collect()]
    if len(few) <= INLINE_IDS:
        matching = rows_with_ids(events, [one for one in few if one is not None])
    else:
        matching = events.join(wanted, "id", "left_semi")
    found = (
        matching.groupBy("id")
        .agg(F.max_by(F.struct(*rest), F.struct("stored_at", "request_id")).alias("_event"))
        .select("id", "_event.*")
    )
    return wanted.join(found, "id", "left").select(*events.columns)


def latest_events(
    events: DataFrame, source: str, n: int, newest_first: bool = True, id_col: str = "id"
) -> DataFrame:
    """The ``n`` most recently stored events of a source."""
    newest = (
        events.filter(F.col("source") == source)
        .orderBy(F.desc("stored_at"), F.desc(id_col))
        .limit(n)
    )
    return newest if newest_first else newest.orderBy("stored_at", id_col)


def replay_listing(events: DataFrame, source: str, n: int = 100) -> DataFrame:
    """Id, type, external id and RFC 3339 time of the latest events of a source."""
    return latest_events(events, source, n).select(
        "id",
        "type",
        "external_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
    )


def newest_per_group(
    df: DataFrame,
    n: int,
    group: Sequence[str] = ("source",),
    time: str = "stored_at",
    row_id: str = "id",
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """The ``n`` newest rows of each group, oldest dropped first; ties go by ``row_id``.

    Without a ``group`` the whole table is one. Rows are filtered by their group's cutoff
    (see `trim_cutoffs`), which is found first, and are never shuffled themselves.
    """
    group = list(group)
    cutoffs = trim_cutoffs(df, n, group, time, row_id, sketch_size)
    return beyond_cutoff(df, cutoffs, group, time, row_id).filter(~F.col("_beyond")).select(*df.columns)


def beyond_cutoff(
    df: DataFrame, cutoffs: DataFrame, group: Sequence[str] = ("source",), time: str = "stored_at", row_id: str = "id",
) -> DataFrame:
    """Rows with boolean ``_beyond``: older than their group's cutoff. A group without cutoff is kept whole."""
    this_row = F.struct(F.col(time).alias("_t"), F.col(row_id).alias("_id"))
    if not group:
        found = cutoffs.first()
        if found is None:
            return df.withColumn("_beyond", F.lit(False))
        oldest = F.struct(F.timestamp_micros(F.lit(found["us"]).cast("long")).alias("_t"), F.lit(found["id"]).alias("_id"))
        return df.withColumn("_beyond", this_row < oldest)
    cutoff = F.struct(F.timestamp_micros("us").alias("_t"), F.col("id").alias("_id"))
    marked = _in_groups(df, cutoffs.select(*group, cutoff.alias("_cutoff")), group, "left")
    return marked.withColumn("_beyond", F.col("_cutoff").isNotNull() & (this_row < F.col("_cutoff"))).drop("_cutoff")


def trim_cutoffs(
    df: DataFrame, n: int, group: Sequence[str] = ("source",), time: str = "stored_at", row_id: str = "id",
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """``group``, ``us`` and ``id`` of the ``n``-th newest row of every group that has more rows.

    Two passes over three columns. The first builds a mergeable quantile sketch of times per
    group, which brackets the cutoff; the second counts the rows above the bracket and ranks those in it,
    by a range partitioning over all groups, so that neither a large group nor one instant with
    very many rows meets in a task. A sketch errs with a small chance: groups whose cutoff does
    not show up in the bracket are ranked whole.
    """
    group = list(group)
    slim = df.select(*group, F.coalesce(F.unix_micros(time), F.lit(OLDEST)).alias("us"), F.col(row_id).alias("id"))
    # Twice the error that sketches of this size keep to in 99 of 100 cases.
    margin = 2 * 2.296 / sketch_size ** 0.9021
    sketched = slim.groupBy(*group).agg(
        F.count("*").alias("rows"), F.kll_sketch_agg_bigint("us", F.lit(sketch_size)).alias("sketch")
    ).filter(F.col("rows") > n)
    rank = (F.col("rows") - n + 0.5) / F.col("rows")
    low = F.floor((rank - margin) * SKETCH_STEPS).cast("int")
    high = F.ceil((rank + margin) * SKETCH_STEPS).cast("int")
    steps = F.lit([step / SKETCH_STEPS for step in range(SKETCH_STEPS + 1)])
    quantiles = sketched.select(
        *group, F.kll_sketch_get_quantile_bigint("sketch", steps).alias("at"), low.alias("low"), high.alias("high")
    )
    brackets = stage_table(quantiles.select(
        *group,
        F.when(F.col("low") > 0, F.get("at", F.col("low"))).otherwise(OLDEST).alias("low"),
        F.when(F.col("high") < SKETCH_STEPS, F.get("at", F.col("high"))).otherwise(NEWEST).alias("high"),
    ), "trim-brackets")
    cutoffs = _ranked_cutoffs(slim, brackets, n, group)
    # A group has one cutoff at most, so equal counts mean that none was missed.
    if brackets.count() == cutoffs.count():
        return cutoffs
    missed = brackets.join(cutoffs, _same(brackets, cutoffs, group), "left_anti") if group else brackets
    whole = missed.withColumns({"low": F.lit(OLDEST), "high": F.lit(NEWEST)})
    return cutoffs.union(_ranked_cutoffs(slim, whole, n, group))


def _ranked_cutoffs(slim: DataFrame, brackets: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Cutoffs of groups whose ``n``-th newest row lies in their bracket."""
    if group:
        bounded = _in_groups(slim, brackets, group)
    else:
        row = brackets.first() or {"low": NEWEST, "high": OLDEST}
        bounded = slim.withColumns({name: F.lit(row[name]).cast("long") for name in ("low", "high")})
        bounded = bounded.filter(F.lit(row["low"] <= row["high"]))
    inside = F.col("us") <= F.col("high")
    # All rows above a bracket become one.
    counted = bounded.filter(F.col("us") >= F.col("low")).groupBy(
        *group, (~inside).alias("above"), F.when(inside, F.col("us")).alias("us"), F.when(inside, F.col("id")).alias("id")
    ).agg(F.count("*").alias("rows"))
    order = [*group, F.desc("above"), F.desc("us"), F.desc("id")]
    ordered = stage_table(
        counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "trim-candidates",
    ).withColumn("part", F.shiftright("place", 33))
    # At most a row per group and partition.
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*group, "part").agg(F.sum("rows").alias("own")).withColumn(
        "newer", F.coalesce(F.sum("own").over(before), F.lit(0))
    ).filter((F.col("newer") < n) & (F.col("newer") + F.col("own") >= n)).select(*group, "part", "newer")
    upto = Window.partitionBy(*group, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _in_groups(ordered, parts, [*group, "part"]).withColumn("upto", F.col("newer") + F.sum("rows").over(upto))
    found = ranked.filter((F.col("upto") >= n) & (F.col("upto") - F.col("rows") < n) & ~F.col("above"))
    return stage_table(
        found.select(*group, F.when(F.col("us") > OLDEST, F.col("us")).alias("us"), "id"), "trim-cutoffs"
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(right[key])
    return match


def _in_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; NULL is a group like any other."""
    renamed = groups.withColumnsRenamed({key: f"_g_{key}" for key in keys})
    match = F.lit(True)
    for key in keys:
        match = match & rows[key].eqNullSafe(renamed[f"_g_{key}"])
    return rows.join(renamed, match, how).drop(*(f"_g_{key}" for key in keys))


def trim_events(events: DataFrame, n: int = EVENTS_PER_SOURCE, **options) -> DataFrame:
    """Bounded history: the ``n`` newest rows of each source."""
    return newest_per_group(events, n, ("source",), **options)


def trim_table(df: DataFrame, n: int, time: str, row_id: str, **options) -> DataFrame:
    """The ``n`` newest rows of a whole table, such as the queue or the dead letters."""
    return newest_per_group(df, n, (), time, row_id, **options)


def parse_stored(entries: DataFrame, column: str = "event") -> DataFrame:
    """Stored JSON entries as variants in ``parsed``, skipping missing or unreadable ones."""
    parsed = computed_once(entries, parsed=strict_document(F.col(column)))
    return parsed.filter(F.col("parsed").isNotNull())


def corrupt_counts(entries: DataFrame, column: str = "event") -> DataFrame:
    """Readable and skipped entries per source."""
    readable = strict_document(F.col(column)).isNotNull()
    return entries.groupBy("source").agg(
        F.count_if(readable).alias("readable"), F.count_if(~readable).alias("skipped")
    )


def backlog(accepted: DataFrame, stored: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Accepted events that are neither stored nor dead-lettered."""
    waiting = accepted.join(stored.select("id"), "id", "left_anti")
    return waiting if dead is None else waiting.join(dead.select("id"), "id", "left_anti")


def backlog_stream(
    accepted: DataFrame, done: DataFrame, wait_seconds: float, lateness_seconds: float, time: str = "received_at",
) -> DataFrame:
    """Accepted events of a stream that are not stored or dead-lettered ``wait_seconds`` after their arrival.

    ``done`` are ``id`` and ``done_at`` of both as they happen. A stream-stream outer join: an event
    waits in state until it is done or the watermarks, ``lateness_seconds`` behind each stream, have
    passed its time to wait, and then comes out once. State holds what arrived in that time.
    """
    arrived = accepted.withWatermark(time, f"{lateness_seconds} seconds")
    finished = done.select(F.col("id").alias("_done"), "done_at").withWatermark("done_at", f"{lateness_seconds} seconds")
    in_time = (F.col("done_at") >= F.col(time)) & (
        F.col("done_at") <= F.col(time) + F.expr(f"INTERVAL '{wait_seconds}' SECOND")
    )
    joined = arrived.join(finished, (F.col("id") == F.col("_done")) & in_time, "left_outer")
    return joined.filter(F.col("_done").isNull()).select(*accepted.columns)

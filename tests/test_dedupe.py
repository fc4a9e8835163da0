"""TTL deduplication against the rule it states, also where keys are cut into slices."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hookloom.functions.claims import compose_maps, follow_claims, slice_maps, slice_marker
from hookloom.operators import dedupe as dd
from hookloom.session import stage_table

ROWS = "external_id string, seconds long, request_id string"


def table(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumn("received_at", F.timestamp_seconds("seconds")).withColumn("source", F.lit("s"))


def by_rule(rows, ttl, last=None):
    """Accepted ids, one row at a time."""
    last, accepted = dict(last or {}), set()
    for key, seconds, row_id in sorted(rows, key=lambda r: (r[1], r[2])):
        if not key or key not in last or seconds >= last[key] + ttl:
            accepted.add(row_id)
            last[key] = seconds
    return accepted


def accepted_ids(df):
    return {r[0] for r in df.filter("accepted").select("request_id").collect()}


@pytest.fixture
def sliced(spark):
    """Keep range partitions apart, so that even small keys lie in several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_claims_are_not_extended(spark):
    hours = [0, 10, 23, 24, 47, 48]
    rows = [("k", h * 3600, f"r{h:02d}") for h in hours] + [("", 0, "e1"), ("", 1, "e2"), (None, 0, "n1"), (None, 0, "n2")]
    got = accepted_ids(dd.dedupe_ttl(table(spark, rows)))
    assert got == {"r00", "r24", "r48", "e1", "e2", "n1", "n2"}


def test_key_parts_are_not_joined_as_text(spark):
    df = spark.createDataFrame(
        [("a:b", "c", "1"), ("a", "b:c", "2"), ("shopify", "12345", "3"), ("stripe", "12345", "4")],
        "source string, external_id string, request_id string",
    ).withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    assert accepted_ids(dd.dedupe_ttl(df)) == {"1", "2", "3", "4"}


rows_strategy = st.lists(
    st.tuples(st.sampled_from(["", "a", "b", "hot", "hot", "hot"]), st.integers(-500, 3000)), max_size=120
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, ttl=st.sampled_from([1, 7, 100, 1000, 10_000]), hot_rows=st.sampled_from([2, 10**6]))
def test_equals_the_rule(sliced, rows, ttl, hot_rows):
    rows = [(key, seconds, f"r{i:04d}") for i, (key, seconds) in enumerate(rows)]
    got = accepted_ids(dd.dedupe_ttl(table(sliced, rows), ttl_seconds=ttl, hot_rows=hot_rows))
    assert got == by_rule(rows, ttl)


@pytest.mark.parametrize("span, ttl", [(100_000, 1000), (5_000, 1000), (300_000, 10), (900, 1000)])
def test_hot_key_in_slices(sliced, span, ttl):
    """A key with most of the rows; the multiplier spreads its rows over the span."""
    rows = [("hot" if i % 3 else f"k{i % 50}", (i * 7919) % span, f"r{i:05d}") for i in range(6000)]
    got = accepted_ids(dd.dedupe_ttl(table(sliced, rows), ttl_seconds=ttl, hot_rows=100))
    assert got == by_rule(rows, ttl)


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_staged_rows_give_the_same(sliced, hot_rows):
    rows = [("hot" if i % 3 else f"k{i % 50}", (i * 7919) % 50_000, f"r{i:05d}") for i in range(2000)]
    got = accepted_ids(dd.dedupe_ttl(
        table(sliced, rows), ttl_seconds=1000, hot_rows=hot_rows, stage=lambda df: stage_table(df, "test")
    ))
    assert got == by_rule(rows, 1000)


def test_claims_of_keys_far_apart_in_time():
    """Spans too wide for one time line are followed key by key."""
    times = np.array([-(2**61), 0, 2**61, -(2**61), 5, 2**61 + 1])
    starts, ends = np.array([0, 3]), np.array([3, 6])
    claimed = follow_claims(times, starts, ends, starts.copy(), 2**60)
    assert claimed.tolist() == [True] * 6
    assert follow_claims(times, starts, ends, np.array([3, 4]), 2**62).tolist() == [False] * 4 + [True, False]


@pytest.mark.parametrize("span, ttl", [(20_000, 2_000), (2_000_000, 2_000)])
def test_thinning_drops_most_of_a_hot_key(sliced, span, ttl):
    """Many rows per TTL are thinned by offset, many TTLs by time."""
    rng = random.Random(span)
    rows = [("hot", rng.randrange(span), f"r{i:05d}") for i in range(20_000)]
    slim = table(sliced, rows).select(
        "source", "external_id", (F.col("seconds") * 1_000_000).alias("us"), "request_id"
    )
    keys = ["source", "external_id"]
    left = dd._thinned_by_time(dd._thinned_by_offset(slim, keys, ttl * 1_000_000), keys, ttl * 1_000_000)
    # Slices reach no further than their partitions: 8 here.
    assert left.count() < 20_000 / 3
    thinned = [(r.external_id, r.us // 1_000_000, r.request_id) for r in left.collect()]
    assert by_rule(thinned, ttl) == by_rule(rows, ttl)


def test_history_blocks_only_live_claims(spark):
    history = [("a", 0, "h1"), ("a", 1000, "h2"), ("b", 0, "h3")]
    rows = [("a", 1500, "r1"), ("a", 1999, "r2"), ("a", 2000, "r3"), ("a", 2500, "r4"), ("b", 1000, "r5"),
            ("b", 1100, "r6"), ("c", 0, "r7"), ("", 1, "r8")]
    past = table(spark, history)
    got = accepted_ids(dd.dedupe_ttl(table(spark, rows), ttl_seconds=1000, history=past))
    assert got == by_rule(rows, 1000, {"a": 1000, "b": 0}) == {"r3", "r5", "r7", "r8"}
    fresh = dd.drop_already_seen(table(spark, rows), past, ttl_seconds=1000)
    assert {r.request_id for r in fresh.collect()} == {"r3", "r4", "r5", "r6", "r7", "r8"}
    assert fresh.columns == table(spark, rows).columns


def test_payload_is_not_shuffled_to_find_duplicates(spark):
    rows = table(spark, [("a", 0, "1"), ("a", 1, "2")]).withColumn("payload", F.lit("x"))
    plan = dd.ttl_duplicates(rows)._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan


def test_time_thinner_is_exact_for_any_batches():
    """Kept rows are those a chain of claims can reach, however rows fall into batches."""
    import numpy as np
    import pandas as pd

    from hookloom.functions.claims import time_thinner

    def reachable(times, ttl):
        reached = times < times[0] + ttl
        for row in range(len(times)):
            if reached[row]:
                follow = np.searchsorted(times, times[row] + ttl)
                if follow < len(times):
                    reached[follow] = True
        return reached

    draw = np.random.default_rng(4)
    for _ in range(60):
        parts, want = [], []
        for key in range(3):
            times = np.unique(draw.integers(0, draw.integers(20, 400), 40))
            if key == 2:
                times = np.arange(0, 60, 3)  # exactly periodic
            parts.append(pd.DataFrame({"k": f"k{key}", "us": times}))
            want.append(parts[-1][reachable(times, 12)])
        rows, size = pd.concat(parts, ignore_index=True), int(draw.integers(1, 30))
        batches = (rows.iloc[at:at + size] for at in range(0, len(rows), size))
        got = pd.concat(time_thinner(["k"], 12)(batches))
        assert got[["k", "us"]].values.tolist() == pd.concat(want)[["k", "us"]].values.tolist()


def staged(df):
    return stage_table(df, "test")


@pytest.mark.parametrize("ttl,each", [(1000, 40), (1000, 1), (7, 3), (100_000, 300)])
def test_periodic_hot_key_is_decided_in_slices(sliced, ttl, each):
    """Rows that come at the same offsets in every TTL: thinning keeps them, slices share them."""
    rng = random.Random(each)
    offsets = sorted(rng.sample(range(ttl), min(each, ttl)))
    periods = 4000 // each
    rows = [("hot", p * ttl + o, f"r{p:05d}-{o}") for p in range(periods) for o in offsets]
    rows += [("warm", i * 11, f"w{i:05d}") for i in range(300)] + [("cold", 3, "c")]
    got = accepted_ids(dd.dedupe_ttl(table(sliced, rows), ttl_seconds=ttl, hot_rows=100, stage=staged))
    assert got == by_rule(rows, ttl)


def test_slices_share_a_periodic_key_evenly(sliced):
    rows = [("hot", i * 10, f"r{i:06d}") for i in range(40_000)]
    slim = table(sliced, rows).select("external_id", F.unix_micros("received_at").alias("us"), "request_id")
    thinned = dd._thinned_by_offset(slim, ["external_id"], 25 * 10**6)
    assert thinned.count() > len(rows) / 2  # thinning does not help here
    claims = dd.sliced_claims(thinned, ["external_id"], 25 * 10**6)
    assert {r.request_id for r in claims.collect()} == by_rule(rows, 25)
    shares = [r["count"] for r in claims.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 3 and max(shares) < 0.5 * sum(shares)


@settings(max_examples=200, deadline=None)
@given(times=st.sets(st.integers(0, 400), min_size=1), cuts=st.sets(st.integers(1, 60), max_size=9), ttl=st.sampled_from([1, 3, 20, 90, 1000]))
def test_maps_of_slices_compose(times, cuts, ttl):
    """Any cut into slices gives the claims of one walk; maps composed pairwise give the same entries."""
    times = sorted(times)
    slices = [part.tolist() for part in np.split(np.array(times), sorted(c for c in cuts if c < len(times))) if len(part)]
    rows = pd.DataFrame([("k", s, t, f"r{t}") for s, part in enumerate(slices) for t in part], columns=["k", "slice", "us", "request_id"])
    maps = pd.concat(list(slice_maps(["k"], ttl)(iter([rows])))).rename(columns={"slice": "node"})
    entries, level, levels = {0: -(2**62)}, maps, []
    while level["node"].max() > 0:
        levels.append(level)
        halves = level.assign(half=level["node"] % 2, node=level["node"] // 2).sort_values(["node", "half", "upto"])
        # In batches that cut through nodes.
        level = pd.concat(list(compose_maps(["k"], ttl)(halves.iloc[i:i + 3] for i in range(0, len(halves), 3))))
    for level in reversed(levels):
        below = {}
        for node, entry in entries.items():
            below[2 * node] = entry
            if (level["node"] == 2 * node + 1).any():
                own = level[(level["node"] == 2 * node) & (level["upto"] >= entry)]
                below[2 * node + 1] = own["leaves"].iloc[0] if len(own) else entry
        entries = below
    told = rows.assign(entry=rows["slice"].map(entries))
    marked = pd.concat(list(slice_marker(["k"], ttl)(told.iloc[i:i + 4] for i in range(0, len(told), 4))))
    assert set(marked["request_id"]) == by_rule([("k", t, f"r{t}") for t in times], ttl)

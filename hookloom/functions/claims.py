"""Per-batch helpers for TTL claims; Spark partitions, shuffles and sorts the rows.

A row claims its key unless an earlier claim is still alive. Each helper gets batches
of one partition whose rows of a key are adjacent and in the order it names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

Batches = Iterator[pd.DataFrame]


def key_starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which the key differs from the row before; always holds row 0."""
    changed = np.zeros(len(batch), dtype=bool)
    changed[0] = True
    for key in keys:
        column = batch[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def whole_runs(batches: Batches, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup batches so that rows equal in ``columns`` are never split between two."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in columns):
            yield pd.concat(held)
            held = []
        last = key_starts(batch, columns)[-1]
        if last:
            yield pd.concat([*held, batch.iloc[:last]])
            held = [batch.iloc[last:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held)


def follow_claims(times: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, ttl_us: int) -> np.ndarray:
    """Mark the claims of several keys at once, from each key's first claim in ``rows``.

    Rows of key k are ``starts[k]:ends[k]``, sorted by time; a first claim at its end
    means none. Keys are laid out one after another on a single time line, so that one
    search finds the next claim of all of them.
    """
    base, width = int(times.min()), int(times.max()) - int(times.min()) + ttl_us + 1
    claimed = np.zeros(len(times), dtype=bool)
    if len(starts) > 1 and len(starts) * width >= 2**62:
        for start, end, row in zip(starts, ends, rows):
            one = slice(start, end)
            claimed[one] = follow_claims(
                times[one], np.array([0]), np.array([end - start]), np.array([row - start]), ttl_us
            )
        return claimed
    line = times
    if len(starts) > 1:
        line = times - base + np.repeat(np.arange(len(starts)) * width, ends - starts)
    while len(rows):
        alive = rows < ends
        rows, ends = rows[alive], ends[alive]
        claimed[rows] = True
        rows = np.searchsorted(line, line[rows] + ttl_us)
    return claimed


def claim_marker(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """Mark claims in rows sorted by key and time. Memory use is one batch."""

    def mark(batches: Batches) -> Batches:
        last_key, free_from = None, None
        for batch in batches:
            if not len(batch):
                continue
            times = batch["us"].to_numpy()
            starts = key_starts(batch, keys)
            ends = np.append(starts[1:], len(batch))
            rows = starts.copy()
            if tuple(batch[k].iloc[0] for k in keys) == last_key:
                rows[0] = np.searchsorted(times[:ends[0]], free_from)
            claimed = follow_claims(times, starts, ends, rows, ttl_us)
            of_last = np.flatnonzero(claimed[starts[-1]:])
            if len(of_last):
                free_from = times[starts[-1] + of_last[-1]] + ttl_us
            last_key = tuple(batch[k].iloc[-1] for k in keys)
            yield pd.DataFrame({"request_id": batch["request_id"], "claimed": claimed})

    return mark


def offset_thinner(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """Drop rows no chain of claims can reach, within a slice of offsets.

    Time is cut into buckets one TTL wide, so a bucket holds at most one claim, and a
    claim at some offset is followed by the first row of the next bucket at that offset
    or later. In each bucket a slice holds the rows of a key with offsets in one range, the
    same one but for an offset that two slices share, so a chain enters it in a bucket at the
    slice's first row there, or comes from the slice's own rows in the bucket before. Input is
    sorted by key, bucket, offset.
    """

    def thin(batches: Batches) -> Batches:
        last_key, last_bucket, reached = None, None, np.empty(0, dtype=np.int64)
        for batch in whole_runs(batches, [*keys, "bucket"]):
            offsets, buckets = batch["offset"].to_numpy(), batch["bucket"].to_numpy()
            columns = [batch[k].to_numpy() for k in keys]
            keep = np.zeros(len(batch), dtype=bool)
            starts = key_starts(batch, [*keys, "bucket"])
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                key, bucket = tuple(c[start] for c in columns), buckets[start]
                here = offsets[start:end]
                rows = np.zeros(1, dtype=np.int64)
                if key == last_key and bucket == last_bucket + 1:
                    follow = np.searchsorted(here, reached)
                    rows = np.union1d(rows, follow[follow < len(here)])
                keep[start + rows] = True
                last_key, last_bucket, reached = key, bucket, here[rows]
            yield batch[keep]

    return thin


def time_thinner(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """Drop rows no chain of claims can reach, within a slice of time.

    A chain enters a slice at some row of its first TTL; each claim is followed by the
    first row one TTL later. Input is sorted by key and time. Memory is one batch and the
    ends of the claims that reach beyond it.
    """

    def thin(batches: Batches) -> Batches:
        last_key, entered_until, pending = None, 0, np.empty(0, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            times = batch["us"].to_numpy()
            keep = np.zeros(len(batch), dtype=bool)
            starts = key_starts(batch, keys)
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                here = times[start:end]
                key = tuple(batch[k].iloc[start] for k in keys)
                if key != last_key:
                    last_key, entered_until, pending = key, here[0] + ttl_us, pending[:0]
                reached = here < entered_until
                # All chains step on together, each by a TTL at least.
                ends, beyond = np.concatenate([pending, here[reached] + ttl_us]), []
                while len(ends):
                    follow = np.searchsorted(here, ends)
                    beyond.append(ends[follow == len(here)])
                    rows = np.unique(follow[follow < len(here)])
                    rows = rows[~reached[rows]]
                    reached[rows] = True
                    ends = here[rows] + ttl_us
                pending = np.unique(np.concatenate([pending[:0], *beyond]))
                keep[start:end] = reached
            yield batch[keep]

    return thin


def next_claims(times: np.ndarray, ttl_us: int) -> np.ndarray:
    """For each row as a claim, the last claim of its chain within these sorted times."""
    rows = np.arange(len(times))
    last = np.searchsorted(times, times + ttl_us)
    last = np.where(last < len(times), last, rows)
    # Pointers double until all lead to ends of chains.
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def slice_maps(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """Jump map of each slice: from when a key is free on entry to when it is free on leaving.

    A slice holds a key's rows of one stretch of time, one row per instant; input is sorted by key,
    slice and time. A map is a step function: a key free from some instant up to ``upto``, and later than
    the entry before, is next free from ``leaves``; free only after the last entry, it
    passes the slice unchanged. A claim before the slice ends at most a TTL after its start,
    so rows of its first TTL are all that can be entered. Memory is one slice.
    """

    def build(batches: Batches) -> Batches:
        for batch in whole_runs(batches, [*keys, "slice"]):
            starts = key_starts(batch, [*keys, "slice"])
            every = batch["us"].to_numpy()
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                times = every[start:end]
                entries = min(np.searchsorted(times, times[0] + ttl_us - 1) + 1, len(times))
                leaves = times[next_claims(times, ttl_us)[:entries]] + ttl_us
                yield _map_rows(batch.iloc[start], keys, int(times[0]), times[:entries], leaves)

    return build


def _map_rows(row: pd.Series, keys: list[str], begins: int, upto: np.ndarray, leaves: np.ndarray) -> pd.DataFrame:
    """Rows of a map, neighbouring entries with one outcome joined."""
    last = np.append(leaves[1:] != leaves[:-1], True)
    node = "slice" if "slice" in row.index else "node"
    return pd.DataFrame({
        **{key: row[key] for key in keys}, node: row[node], "begins": begins, "upto": upto[last], "leaves": leaves[last],
    })


def compose_maps(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """Map of a node from those of its two halves, the earlier then the later.

    Input has the columns of a map with its ``node`` halved and ``half`` 0 or 1, sorted by key, node, half
    and ``upto``. Memory is the maps of two halves.
    """

    def compose(batches: Batches) -> Batches:
        for batch in whole_runs(batches, [*keys, "node"]):
            starts = key_starts(batch, [*keys, "node"])
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                both = batch.iloc[start:end]
                second = both["half"].to_numpy() == 1
                upto, leaves = both["upto"].to_numpy(), both["leaves"].to_numpy()
                begins = int(both["begins"].iloc[0])
                if second.any() and not second.all():
                    first_upto, first_leaves = upto[~second], leaves[~second]
                    later_upto, later_leaves = upto[second], leaves[second]
                    at = np.searchsorted(later_upto, first_leaves)
                    met = at < len(later_upto)
                    through = np.where(met, later_leaves[np.minimum(at, len(later_upto) - 1)], first_leaves)
                    # Keys free too late for the first half enter the second, as far as its entries can be reached.
                    skips = later_upto > first_upto[-1]
                    reach = np.searchsorted(later_upto[skips], begins + ttl_us - 1) + 1
                    upto = np.append(first_upto, later_upto[skips][:reach])
                    leaves = np.append(through, later_leaves[skips][:reach])
                yield _map_rows(both.iloc[0], keys, begins, upto, leaves)

    return compose


def slice_marker(keys: list[str], ttl_us: int) -> Callable[[Batches], Batches]:
    """The claims of each slice, whose key is free from ``entry``; sorted by key, slice and time. Memory is one batch."""

    def mark(batches: Batches) -> Batches:
        last_run, free_from = None, None
        for batch in batches:
            if not len(batch):
                continue
            times, entry = batch["us"].to_numpy(), batch["entry"].to_numpy()
            runs = [batch[c].to_numpy() for c in (*keys, "slice")]
            starts = key_starts(batch, [*keys, "slice"])
            ends = np.append(starts[1:], len(batch))
            free = entry[starts].copy()
            if tuple(run[0] for run in runs) == last_run:
                free[0] = free_from
            rows = np.array([s + np.searchsorted(times[s:e], f) for s, e, f in zip(starts, ends, free)])
            claimed = follow_claims(times, starts, ends, rows, ttl_us)
            of_last = np.flatnonzero(claimed[starts[-1]:])
            free_from = times[starts[-1] + of_last[-1]] + ttl_us if len(of_last) else free[-1]
            last_run = tuple(run[-1] for run in runs)
            yield pd.DataFrame({"request_id": batch["request_id"][claimed]})

    return mark

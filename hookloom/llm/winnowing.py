"""Document fingerprints by winnowing.

Every run of ``gram`` characters is hashed by a rolling polynomial; of each ``window`` neighbouring
hashes the smallest is chosen, the rightmost of equal ones, and kept with its position. Two texts
that share a passage of at least ``window + gram - 1`` characters share a fingerprint of it,
and no two neighbouring positions lie more than ``window`` apart. Texts with fewer characters than that are one
window; a text shorter than a gram is one gram.

The report compares each document with a copy whose second half is replaced by the start of the
next document, and with that document. Neighbours in the order of ids are found without one
task seeing all rows: keys alone are range partitioned to get split points, one for each shuffle
partition. Rows then go to the part their key falls in, and the first row of a
part also to the part before it, so texts are shuffled once. A part is streamed in order with one row held.
Rows that repeat exactly more often than a part should hold are counted first; the copies
need no neighbour but themselves and are dealt out in shares.

Defined cases. A null text is empty; an empty text has no fingerprint, and two of those are
alike (1.0). Ids fall; rows without one come last, and equal ids are ordered by a hash of their
texts. Every repeated row is reported. The only row is its own next. An empty table gives no rows.
Other columns are not looked at. Likeness is the share of distinct hashes that both texts have of those either has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.llm.common import whole_text
from hookloom.session import stage_table

GRAM, WINDOW = 16, 25
# Characters hashed at once; longer texts are hashed in overlapping blocks.
BLOCK = 1 << 20

# Odd, so that its powers have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), dtype=np.uint64)


def _power_table(length: int) -> np.ndarray:
    """Powers of the base and of its inverse, kept and doubled when a longer text comes."""
    global _powers
    if _powers.shape[1] < length:
        size = 1 << (length - 1).bit_length()
        steps = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=np.uint64)
        _powers = np.cumprod(np.concatenate([np.ones((2, 1), dtype=np.uint64), np.repeat(steps, size - 1, axis=1)], axis=1), axis=1)
    return _powers


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` code points, modulo 2^64.

    The rolling sum over a run is the difference of two prefix sums, brought to the
    same power of the base; its bits are then mixed, as the low ones of a polynomial are weak.
    """
    count = len(points) - gram + 1
    table = _power_table(len(points))
    prefix = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * table[1, :len(points)], out=prefix[1:])
    rolled = (prefix[gram:] - prefix[:count]) * table[0, :count]
    # Multipliers and shifts of a common 64-bit finalizer.
    rolled = (rolled ^ (rolled >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled = (rolled ^ (rolled >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return rolled ^ (rolled >> np.uint64(31))


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of each window's smallest hash, the rightmost of equal ones, ascending and once each."""
    count = len(hashes)
    window = min(window, count)
    # Minima over windows whose width doubles, then two that overlap.
    lowest, at, width = hashes, np.arange(count), 1
    while width < window:
        step = min(width, window - width)
        left, right = lowest[:-step], lowest[step:]
        later = right <= left
        lowest, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        width += step
    return at[np.append(True, at[1:] != at[:-1])]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions in ``text``, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    gram = min(gram, len(points))
    count = len(points) - gram + 1
    if count <= block:
        hashes = gram_hashes(points, gram)
        at = window_minima(hashes, window)
        return hashes[at], at
    chosen, values = [], []
    # Blocks share all but one hash of a window, so that every window lies in some block.
    for start in range(0, count - window + 1, block - window + 1):
        hashes = gram_hashes(points[start:start + block + gram - 1], gram)
        at = window_minima(hashes, window)
        values.append(hashes[at])
        chosen.append(at + start)
    at, first = np.unique(np.concatenate(chosen), return_index=True)
    return np.concatenate(values)[first], at


def likeness(first: np.ndarray, second: np.ndarray) -> float:
    """Share of common among all distinct hashes; 1.0 where there are none."""
    if not len(first) and not len(second):
        return 1.0
    first, second = np.unique(first), np.unique(second)
    both = len(np.intersect1d(first, second, assume_unique=True))
    return both / (len(first) + len(second) - both)


def packed(hashes: np.ndarray, at: np.ndarray) -> str:
    """Ten hex digits a fingerprint: the upper half of its hash, and the step from the position before.

    The first step counts from 0. A step is at most a window, which must fit one byte.
    """
    row = np.empty((len(at), 5), dtype=np.uint8)
    row[:, :4] = (hashes >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    row[:, 4] = np.diff(at, prepend=0)
    return row.tobytes().hex()


def unpacked(fingerprint: str) -> tuple[list[int], list[int]]:
    """Upper halves of hashes and positions of a packed fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 5)
    return rows[:, :4].copy().view(">u4").ravel().tolist(), np.cumsum(rows[:, 4].astype(np.int64)).tolist()


def fingerprints(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Whole fingerprints as ``array<struct<hash, position>>``; ``hash`` is the 64-bit value as a signed long."""
    @F.pandas_udf("array<struct<hash: long, position: long>>")
    def chosen(texts: pd.Series) -> pd.Series:
        def one(value: str) -> list[dict]:
            hashes, at = winnow(value, gram, window)
            return [{"hash": h, "position": p} for h, p in zip(hashes.view(np.int64).tolist(), at.tolist())]

        return texts.map(one)

    return chosen(whole_text(text))


KEY = ["missing", "falling", "content"]


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``text`` and a key whose ascending order is that of falling ids, nulls last."""
    number, body = F.col(f"`{doc_id}`").cast("long"), whole_text(F.col(f"`{text}`"))
    return docs.select(
        number.alias("id"), body.alias("text"), number.isNull().alias("missing"),
        F.coalesce(F.bitwise_not(number), F.lit(0)).alias("falling"), F.xxhash64(body).alias("content"),
    )


def _place(splits: list[tuple]) -> Callable[..., Column]:
    """The part a key falls in, and whether the key starts it."""
    @F.pandas_udf("own int, starts boolean")
    def place(missing: pd.Series, falling: pd.Series, content: pd.Series) -> pd.DataFrame:
        keys = list(zip(missing, falling, content))
        own = [max(bisect_right(splits, key) - 1, 0) for key in keys]
        starts = [bool(splits) and splits[at] == key for at, key in zip(own, keys)]
        return pd.DataFrame({"own": pd.Series(own, dtype="int32"), "starts": pd.Series(starts, dtype="bool")})

    return place


def _in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows dealt to parts in order: ``part, ghost``, the key, ``id, text, copies, alone``.

    A ghost is the row that follows the last of its part. ``alone`` marks copies that
    only follow themselves.
    """
    rows = _keys(docs, doc_id, text)
    counted = stage_table(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "order-keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = counted.repartitionByRange(parts, *KEY).groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.struct(*KEY)).alias("key"), F.sum("n").alias("n")
    ).collect()  # a row per partition
    splits = sorted(tuple(row["key"]) for row in firsts)
    share = max(2, sum(row["n"] for row in firsts) // max(len(firsts), 1))

    rows = rows.withColumns({"copies": F.lit(1).cast("long"), "piece": F.lit(0)})
    # At most as many keys as partitions repeat more often than the average partition has rows.
    hot = counted.filter(F.col("n") > share).select(*KEY, "n")
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        once = rows.join(hot, KEY).groupBy(*KEY).agg(
            F.first("id").alias("id"), F.first("text").alias("text"), F.first("n").alias("n")
        )
        shares = F.expr(f"transform(sequence(0L, (n - 1) div {share}), i -> least(n - i * {share}, {share}L))")
        dealt = once.select("id", "text", *KEY, F.posexplode(shares).alias("piece", "copies"))
        rows = rows.join(hot.select(*KEY), KEY, "left_anti").select(*dealt.columns).union(dealt)
    last = max(len(splits) - 1, 0)
    placed = rows.withColumn("at", _place(splits)(*KEY)).withColumn("alone", F.col("piece") > 0)
    own = F.col("at.own")
    # The row that starts a part follows the part before; that of the first part, the last.
    before = F.when(own == 0, last).otherwise(own - 1)
    here = F.struct(((own + F.col("piece")) % (last + 1)).alias("part"), F.lit(False).alias("ghost"))
    targets = F.when(
        F.col("at.starts") & ~F.col("alone"), F.array(here, F.struct(before.alias("part"), F.lit(True).alias("ghost")))
    ).otherwise(F.array(here))
    return placed.select(*KEY, "id", "text", "copies", "alone", F.inline(targets))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, copies long"
)


def edited_text(text: str, following: str) -> str:
    """``text`` with its second half replaced by as many characters of the start of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(gram: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def report(doc_id: int | None, text: str, own: tuple, following: str, other: tuple, copies: int) -> tuple:
        edited = edited_text(text, following)
        changed = winnow(edited, gram, window)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(*own), packed(*changed),
            likeness(own[0], changed[0]), likeness(own[0], other[0]), copies,
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            columns = (batch.column(name).to_pylist() for name in ("part", "ghost", "alone", "id", "text", "copies"))
            for part, ghost, alone, doc_id, text, copies in zip(*columns):
                if ghost and (held is None or held[0] != part):
                    continue  # a further copy of the row that follows the part
                own = winnow(text, gram, window)
                if alone:
                    out.append(report(doc_id, text, own, text, own, copies))
                    continue
                if held is not None and held[0] == part:
                    _, its_id, its_text, its_own, its_copies = held
                    out.append(report(its_id, its_text, its_own, text, own, 1))
                    if its_copies > 1:
                        out.append(report(its_id, its_text, its_own, its_text, its_own, its_copies - 1))
                held = None if ghost else (part, doc_id, text, own, copies)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*out), _ARROW)], schema=_ARROW)

    return compare


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("copies", pa.int64()),
])


def fingerprint_report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_chars``, the edited text's digest, both packed fingerprints, their likeness and
    that to the next document's fingerprint."""
    if window > 255:
        raise ValueError("positions are packed for windows of at most 255")
    placed = _in_order(docs, doc_id, text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "alone", "ghost", *KEY)
    compared = ordered.select("part", "ghost", "alone", "id", "text", "copies").mapInArrow(_compare(gram, window), SCHEMA)
    each = F.when(F.col("copies") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return compared.withColumn("copy", F.explode(each)).drop("copies", "copy")

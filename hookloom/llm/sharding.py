"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts stay together; only a group that is larger than a shard's even share, in
any dimension, is cut into pieces by a hash of its rows. Units of packing are of bounded number:
each group above a bundle's size is one, pieces of cut groups are, and smaller groups
are hashed, whole, into bundles. Every unit's bytes, tokens and rows are measured. Units are placed from the largest down, each on the shard where the dot
product of its vector with the shard's residual capacity is highest, among shards with room
in every dimension if there are any. Swaps between the fullest and the emptiest shard then
level the bytes. Only the units' sums reach the driver; their number
depends on the shards, not on the rows.

Slots number a shard's rows without gaps: units and row ranges of bounded size are counted
and offset, and rows are numbered within their range.

The shard of a row follows from its text, and in a cut group from its id, not from where it lies; equal rows
of a cut group are numbered, so as many of them are in each shard however the table is partitioned.

Defined cases: null texts have no bytes, no tokens and the checksum of an empty text; they
are one group with empty texts. Repeated rows get slots of their own. Shards may stay empty
if there are fewer rows than shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hookloom.llm.common import BLANKS, broadcast_if_small, whole_text
from hookloom.session import stage_table

UNITS_PER_SHARD = 512
MAX_UNITS = 1 << 20
# Rows that are numbered within one window.
RANGE_ROWS = 200_000
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; ``vectors`` has a row per unit and a column per dimension."""
    totals = vectors.sum(axis=0)
    parts = vectors / np.where(totals > 0, totals, 1)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    chosen = np.zeros(len(vectors), dtype=np.int64)
    order = np.lexsort((np.arange(len(vectors)), -parts.max(axis=1)))
    for unit in order:
        part = parts[unit]
        score = residual @ part
        room = (residual >= part - 1e-12).all(axis=1)
        if room.any():
            score = np.where(room, score, -np.inf)
        chosen[unit] = shard = int(score.argmax())
        residual[shard] -= part
    return chosen


def level(vectors: np.ndarray, chosen: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Swap units of equal rows between fuller shards and the emptiest while that levels the bytes.

    Of the swaps that close most of the gap, the one that moves fewest tokens is taken.
    """
    chosen = chosen.copy()
    size, tokens, rows = vectors.T
    for _ in range(rounds):
        loads = np.bincount(chosen, weights=size, minlength=shards)
        low = int(loads.argmin())
        swap = None
        for high in np.argsort(-loads, kind="stable"):
            gap = loads[high] - loads[low]
            if gap < 2 or swap is not None:
                break
            options = []
            for count in np.unique(rows[chosen == high]):
                ours = np.flatnonzero((chosen == high) & (rows == count))
                theirs = np.flatnonzero((chosen == low) & (rows == count))
                if not len(theirs):
                    continue
                theirs = theirs[np.argsort(size[theirs], kind="stable")]
                near = np.searchsorted(size[theirs], size[ours] - gap / 2)
                for shift in (-1, 0):
                    other = theirs[np.clip(near + shift, 0, len(theirs) - 1)]
                    moved = size[ours] - size[other]
                    left = np.where((moved > 0) & (moved < gap), np.abs(gap - 2 * moved) / gap, np.inf)
                    options.append(np.stack([np.maximum(left, 0.1), np.abs(tokens[ours] - tokens[other]), ours, other]))
            table = np.concatenate(options, axis=1) if options else np.empty((4, 0))
            table = table[:, np.isfinite(table[0])]
            if table.size:
                best = np.lexsort((table[1], table[0]))[0]
                swap = int(table[2, best]), int(table[3, best]), low, int(high)
        if swap is None:
            break
        chosen[swap[0]], chosen[swap[1]] = swap[2], swap[3]
    return chosen


def _with_repeats(rows: DataFrame, cut: DataFrame, salts: int = 64) -> DataFrame:
    """Rows with ``repeat``: 0, but the number of a row among equal ones of a cut group.

    Repeats are numbered within salts and then offset, so no task sees them all.
    """
    own = rows.join(cut, "text_key", "left_semi").select("text_key", "id", "at", F.pmod("at", F.lit(salts)).alias("salt"))
    counts = stage_table(own.groupBy("text_key", "id", "salt").agg(F.count("*").alias("n")), "shard-repeats")
    everywhere = Window.partitionBy("text_key", "id")
    before = everywhere.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    repeated = counts.select(
        "text_key", "id", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(everywhere).alias("all")
    ).filter("all > 1")
    if repeated.isEmpty():
        return rows.withColumn("repeat", F.lit(0).cast("long"))
    same = (own["text_key"] == repeated["text_key"]) & own["id"].eqNullSafe(repeated["id"]) & (own["salt"] == repeated["salt"])
    within = Window.partitionBy("text_key", "id", "salt").orderBy("at")
    numbers = own.join(repeated.drop("all"), same).select(own["text_key"], own["id"], own["salt"], "at", "offset").select(
        "at", (F.col("offset") + F.row_number().over(within) - 1).alias("repeat")
    )
    return rows.join(numbers, "at", "left").withColumn("repeat", F.coalesce("repeat", F.lit(0).cast("long")))


def assign_shards(
    docs: DataFrame, carry: list[str], shards: int = 8, text: str = "text", doc_id: str = "doc_id",
    units_per_shard: int = UNITS_PER_SHARD,
) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``id``, ``size``, ``text_crc32``,
    ``tokens``, ``shard`` and ``slot``.
    """
    units = shards * units_per_shard
    if not 0 < units <= MAX_UNITS:
        raise ValueError(f"shards times units per shard must be at most {MAX_UNITS}")
    content = whole_text(F.col(f"`{text}`"))
    blank = F.translate(content, BLANKS, " " * len(BLANKS))
    rows = stage_table(docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        F.col(f"`{doc_id}`").alias("id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.size(F.array_remove(F.split(blank, " +"), "")).cast("long").alias("tokens"),
        F.xxhash64(content).alias("text_key"),
        F.monotonically_increasing_id().alias("at"),
    ), "shard-rows")
    groups = stage_table(rows.groupBy("text_key").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    ), "shard-groups")
    totals = groups.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in DIMENSIONS)).first()

    # Groups above a bundle's size; as shares add up to one in each dimension, at most 3 x units.
    share = F.greatest(*(F.col(name) / F.lit(float(max(totals[name], 1))) for name in DIMENSIONS))
    large = groups.withColumn("share", share).filter(F.col("share") * units > 1).select(
        "text_key", F.when(F.col("share") * shards > 1, F.ceil(F.col("share") * units)).otherwise(1).cast("int").alias("pieces")
    )
    large = broadcast_if_small(stage_table(large, "shard-large"))
    rows = _with_repeats(rows, large.filter("pieces > 1").select("text_key"))
    placed = rows.join(large, "text_key", "left").withColumn(
        "unit", F.when(F.col("pieces").isNull(), F.struct(
            F.pmod("text_key", F.lit(units)).alias("bundle"), F.lit(0).alias("piece")
        )).otherwise(F.struct(
            F.col("text_key").alias("bundle"),
            (F.pmod(F.xxhash64("id", "repeat"), "pieces") + 1).cast("int").alias("piece"),
        ))
    )
    sums = placed.groupBy("unit").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    )
    sums = stage_table(sums.select("unit.bundle", "unit.piece", *DIMENSIONS), "shard-units")
    table = sums.orderBy("bundle", "piece").toPandas()
    vectors = table[list(DIMENSIONS)].to_numpy(dtype=float)
    table["shard"] = level(vectors, pack(vectors, shards), shards)
    table["number"] = np.arange(len(table))
    table["ranges"] = np.maximum(1, -(-table["rows"].to_numpy(dtype=np.int64) // RANGE_ROWS))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [tuple(map(int, row)) for row in table[["bundle", "piece", "shard", "number", "ranges"]].itertuples(index=False)],
        "bundle long, piece int, shard int, number int, ranges long",
    )
    found = placed.select("*", "unit.bundle", "unit.piece").join(
        F.broadcast(plan), ["bundle", "piece"]
    ).withColumn("range", F.pmod(F.xxhash64("at"), "ranges").cast("int"))

    counts = stage_table(found.groupBy("shard", "number", "range").agg(F.count("*").alias("n")), "shard-counts")
    upward = Window.partitionBy("shard").orderBy("number", "range")
    offsets = counts.select("number", "range", (F.sum("n").over(upward) - F.col("n")).alias("offset"))
    offsets = broadcast_if_small(stage_table(offsets, "shard-offsets"))
    within = Window.partitionBy("number", "range").orderBy("id", "text_key", "at")
    return found.join(offsets, ["number", "range"]).select(
        "row", "id", "size", "text_crc32", "tokens", "shard",
        (F.col("offset") + F.row_number().over(within) - 1).alias("slot"),
    )


def _law(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(
        *columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


def sharding_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of every document."""
    return _law(assign_shards(docs, ["doc_id"], shards).drop("row").withColumnRenamed("id", "doc_id"), "doc_id")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with their shard and slot."""
    return _law(assign_shards(docs, docs.columns, shards), "row.*")

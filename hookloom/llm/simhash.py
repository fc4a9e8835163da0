"""SimHash near-duplicates: fingerprints, links of few differing bits, groups.

Fingerprints are split into ``max_distance + 2`` blocks. Two of them that differ in at most
``max_distance`` bits share at least two blocks, so an equi-join on every pair of blocks
finds all close pairs, which their bit distance then confirms. Equal fingerprints are one
node from the start, so groups of exact copies cost nothing.

A bucket of many different fingerprints is not paired off. Two fingerprints differ in at
most two bits exactly if some word lies within one bit of both; each member of a large
bucket is linked to the words one bit away (in the bits its blocks leave open), which is
linear in the members and joins the same groups.

Defined cases: texts without words, null ones too, have fingerprint zero and are linked
like any other. Rows that share an id and a text, or only an id, each get a row. A null id
is never a component id unless all ids of the group are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from hookloom.llm.common import whole_text
from hookloom.llm.components import connected_components
from hookloom.session import stage_table

SEED = 42
# Members from which a bucket is linked through words one bit away: 32 open bits and the
# word itself cost as much as pairing 66 members. The groups found are the same.
PAIRED_MEMBERS = 64
SHINGLES_AT_ONCE = 1 << 16


def text_fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``."""
    words = text.encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    windows = max(len(words) - shingle + 1, 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, windows, SHINGLES_AT_ONCE):
        stop = min(start + SHINGLES_AT_ONCE, windows)
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[at:at + shingle]), SEED) for at in range(start, stop)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > windows, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    @F.pandas_udf(LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(text, shingle) for text in texts], dtype="int64")

    return fingerprints(whole_text(text))


def block_masks(max_distance: int) -> list[int]:
    """Masks, as signed longs, of every pair of blocks."""
    blocks = max_distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [_signed(a | b) for a, b in combinations(parts, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def close_links(prints: DataFrame, max_distance: int = 2, paired_members: int = PAIRED_MEMBERS) -> DataFrame:
    """Links ``a``–``b`` that join exactly the fingerprints ``fp`` within the distance.

    Some nodes of links are words that are no fingerprint but lie between two of them.
    """
    if not 1 <= max_distance <= 2:
        raise ValueError("the distance must be 1 or 2")
    masks = block_masks(max_distance)
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks)))
                          .alias("mask", "block"))
    sizes = keyed.groupBy("mask", "block").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stage_table(keyed.join(sizes, ["mask", "block"]), "simhash-buckets")

    small = shared.filter(F.col("members") <= paired_members)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    paired = small.select("mask", "block", F.col("fp").alias("a")).join(
        small.select("mask", "block", F.col("fp").alias("b")), ["mask", "block"]
    ).filter(F.col("a") < F.col("b")).filter(close).select("a", "b")

    large = shared.filter(F.col("members") > paired_members)
    flips = [F.lit(_signed(1 << bit)) for bit in range(64)]
    open_bits = F.array(*(F.array(*(
        flip for bit, flip in enumerate(flips) if not (mask >> bit) & 1
    )) for mask in masks))
    near = large.select(
        "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), open_bits[F.col("mask")])).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).distinct()
    if max_distance == 1:
        # Only words that are fingerprints themselves are one bit away from another.
        met = near.join(prints.select(F.col("fp").alias("word")), "word", "left_semi")
    else:
        met = near.join(
            near.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word"), "word", "left_semi"
        )
    return paired.union(met.filter("fp <> word").select(F.col("fp").alias("a"), F.col("word").alias("b")))


def near_duplicate_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_distance: int = 2,
) -> DataFrame:
    """One row per document: ``id``, ``row_key`` (a hash of all its columns), ``fp``, ``root`` (one of
    its group's words) and ``component_id``. No texts are written.
    """
    rows = stage_table(docs.select(
        F.col(f"`{doc_id}`").alias("id"), row_key(docs).alias("row_key"),
        fingerprint(F.col(f"`{text}`"), shingle).alias("fp"),
    ), "simhash-rows")
    prints = stage_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-prints")
    roots = connected_components(close_links(prints.select("fp"), max_distance))
    named = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = stage_table(named.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage_table(named.join(groups, "root").select("fp", "root", "component_id"), "simhash-groups")
    return rows.join(named, "fp")


def row_key(docs: DataFrame) -> Column:
    """64-bit hash of a row's columns; nested ones, which may hold maps, count by their JSON."""
    columns = []
    for field in docs.schema:
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType))
        columns.append(F.to_json(column) if nested else column)
    return F.xxhash64(*columns)


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicate_groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The document with the smallest id of each group (of equal ids, one), with its columns.

    The rows that stay are found by id and hash; of rows equal in all columns the first
    counts. That join is the only shuffle of texts.
    """
    found = near_duplicate_groups(docs, shingle=shingle, max_distance=max_distance)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    kept = found.groupBy("root").agg(F.min(first).alias("first"))
    kept = stage_table(kept.select(
        F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("k_id"), F.col("first.row_key").alias("k_row")
    ), "simhash-kept")
    keyed = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), row_key(docs).alias("k_row"),
    )
    equal = Window.partitionBy("k_id", "k_row").orderBy("k_id", "k_row")
    stayed = keyed.join(kept, ["k_id", "k_row"], "left_semi").withColumn("copy", F.row_number().over(equal))
    return stayed.filter("copy = 1").select("row.*")

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of thirteen words; a window is the run of its word
shingles. A text that holds a window holds all its shingles, so also its rarest one, the
window's necessary prefix. The join runs in these steps, all DataFrame functions:

1. Every text position whose shingle occurs in the benchmark is kept, as a hash.
2. Shingles are ordered by how often the corpus has them; each window's rarest is chosen.
3. Texts and items meet on these prefix shingles only. The position of the match fixes
   where the item would lie in the text; windows that would start before the text or end
   beyond it fall out (positional and length bounds).
4. Each meeting is verified: runs of consecutive shingles of the item, found at just
   those positions, that are as long as a window. A window's words are equal if the hashes
   of all its shingles agree, eleven 64-bit hashes for thirteen words.

Defined cases: null and empty texts have no words, are not contaminated and contaminate
nothing. Items of fewer words than a window are one window. Repeated benchmark rows count
once; rows that share an item id are windows of one item. A null item id is written as an
empty string. Repeated documents get equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hookloom.llm.common import broadcast_if_small, let, lower_ascii, positions, split_words, whole_text
from hookloom.session import stage_table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3


def contract_words(text: Column) -> Column:
    return split_words(lower_ascii(whole_text(text)), SEPARATORS)


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each position on."""

    def hashes(words: Column) -> Column:
        return F.transform(
            positions(F.size(words) - (size - 1)),
            lambda at: F.xxhash64(*(words[at + step] for step in range(size))),
        )

    return let(words, hashes)


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """Benchmark shingles: ``item`` (a number), ``item_id``, ``size`` (shingle words), ``span``
    (shingles in a window), ``ipos``, ``last`` (the item's last position) and ``h``.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"),
        contract_words(F.col(f"`{text}`")).alias("words"),
    ).filter(F.size("words") > 0).distinct()
    items = items.withColumns({
        "item": F.xxhash64("item_id", "words"),
        "size": F.least(F.size("words"), F.lit(shingle)),
        "span": F.least(F.size("words"), F.lit(window)) - F.least(F.size("words"), F.lit(shingle)) + 1,
    })
    hashes = F.lit(None).cast("array<bigint>")
    for size in range(1, shingle + 1):
        hashes = F.when(F.col("size") == size, shingle_hashes(F.col("words"), size)).otherwise(hashes)
    return items.select("item", "item_id", "size", "span", hashes.alias("hashes")).select(
        "item", "item_id", "size", "span", (F.size("hashes") - 1).alias("last"), F.posexplode("hashes").alias("ipos", "h")
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``id``, ``n_words``, ``n_hit``, ``item_ids``."""
    bench = stage_table(benchmark_windows(benchmark, item_id, item_text, window, shingle), "bench-shingles")
    sizes = sorted(row["size"] for row in bench.select("size").distinct().collect())  # at most ``shingle``
    vocabulary = broadcast_if_small(stage_table(bench.select("size", "h").distinct(), "bench-vocabulary"))

    # The key stands for a text of a document; repeated rows share it.
    keyed = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tk"),
        contract_words(F.col(f"`{text}`")).alias("words"),
    )
    found = None
    for size in sizes:
        hits = keyed.select(
            "id", "tk", F.size("words").alias("n_words"),
            F.posexplode(shingle_hashes(F.col("words"), size)).alias("pos", "h"),
        ).withColumn("size", F.lit(size)).join(vocabulary, ["size", "h"], "left_semi")
        found = hits if found is None else found.union(hits)
    if found is None:
        empty = "array<string>"
        return docs.select(
            F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"), F.col(f"`{doc_id}`").alias("id"),
            F.size(contract_words(F.col(f"`{text}`"))).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"), F.array().cast(empty).alias("item_ids"),
        )
    hits = stage_table(found, "bench-hits")

    # Each window's rarest shingle in the corpus.
    counts = hits.groupBy("size", "h").agg(F.count("*").alias("df"))
    ranked = bench.join(broadcast_if_small(stage_table(counts, "bench-counts")), ["size", "h"], "left")
    rarity = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "ipos")
    starts = ranked.select(
        "item", "span", "last", "size", rarity.alias("rarity"),
        F.explode(F.sequence(F.greatest(F.col("ipos") - F.col("span") + 1, F.lit(0)),
                             F.least(F.col("ipos"), F.col("last") - F.col("span") + 1))).alias("wstart"),
    )
    prefixes = starts.groupBy("item", "span", "size", "wstart").agg(F.min("rarity").alias("rarity")) \
        .filter(F.col("rarity.df") > 0) \
        .select("item", "span", "size", "wstart", F.col("rarity.h").alias("h"), F.col("rarity.ipos").alias("ipos"))
    prefixes = broadcast_if_small(stage_table(prefixes, "bench-prefixes"))

    # Where an item would lie, by its prefix shingles.
    starts_at = F.col("pos") - F.col("ipos") + F.col("wstart")
    meetings = hits.join(prefixes, ["size", "h"]) \
        .filter((starts_at >= 0) & (starts_at + F.col("span") + F.col("size") - 1 <= F.col("n_words"))) \
        .select("id", "tk", "n_words", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    meetings = stage_table(meetings, "bench-meetings")

    # Consecutive shingles of the item at those positions, in runs of a window or more.
    expected = meetings.join(broadcast_if_small(bench), "item").select(
        "id", "tk", "item", "item_id", "size", "span", "shift", "ipos", (F.col("shift") + F.col("ipos")).alias("pos"), "h"
    ).filter((F.col("pos") >= 0) & (F.col("pos") + F.col("size") <= F.col("n_words")))
    present = hits.select(*(F.col(name).alias(f"t_{name}") for name in ("id", "tk", "size", "pos", "h")))
    matched = expected.join(present, (
        F.col("id").eqNullSafe(F.col("t_id")) & (F.col("tk") == F.col("t_tk")) & (F.col("size") == F.col("t_size"))
        & (F.col("pos") == F.col("t_pos")) & (F.col("h") == F.col("t_h"))
    ), "left_semi")
    along = Window.partitionBy("id", "tk", "item", "shift").orderBy("ipos")
    runs = matched.withColumn("run", F.col("ipos") - F.row_number().over(along)) \
        .groupBy("id", "tk", "item", "item_id", "size", "span", "shift", "run") \
        .agg(F.min("pos").alias("begin"), F.count("*").alias("length")) \
        .filter(F.col("length") >= F.col("span")) \
        .select("id", "tk", "item_id", "begin", (F.col("begin") + F.col("length") + F.col("size") - 1).alias("end"))
    runs = stage_table(runs, "bench-runs")

    before = Window.partitionBy("id", "tk").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = runs.select("id", "tk", "begin", "end").distinct() \
        .withColumn("fresh", F.greatest(F.col("end") - F.greatest(F.col("begin"), reached), F.lit(0)))
    words_hit = spans.groupBy("id", "tk").agg(F.sum("fresh").alias("n_hit"))
    items_hit = runs.groupBy("id", "tk").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    summary = words_hit.withColumnsRenamed({"id": "s_id", "tk": "s_tk"}).join(
        items_hit, F.col("s_id").eqNullSafe(F.col("id")) & (F.col("s_tk") == F.col("tk"))
    ).select("s_id", "s_tk", "n_hit", "item_ids")
    summary = broadcast_if_small(stage_table(summary, "bench-summary"))

    rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tk"),
        F.size(contract_words(F.col(f"`{text}`"))).cast("long").alias("n_words"),
    )
    return rows.join(
        summary, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_tk")), "left"
    ).select(
        "row", "id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs, benchmark, ["doc_id"]).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return find_contamination(docs, benchmark, docs.columns).filter(~contaminated()).select("row.*")

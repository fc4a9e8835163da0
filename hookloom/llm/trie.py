"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of leading turns; its members are the conversations that
start with it. A node is named by its smallest member and its depth, which is exact: the
first ``depth`` turns of that conversation are the node.

Prefixes are found without walking a conversation in one task. Turns are numbered by a
range partitioning of all of them; a prefix is the exclusive-or of 128-bit hashes of its
numbered turns, taken in blocks of turns and then over blocks. Subtree totals come from
tree contraction: each round rakes all leaves into their parents and takes nodes out of
unary chains, so rounds grow with the logarithm of the depth; contracted nodes are put
back in reverse order. All joins of the rounds are on keys that are unique on both sides,
and sums by parent are combined before their shuffle, so that a node with any number of
children or members burdens no task.

Defined cases. Null roles and texts are empty, null turns come first. Turns of a conversation
with equal numbers are ordered by role, then by a hash of role and text; repeated rows are repeated
turns. Rows without a ``conv_id`` belong to no conversation and are left out. A table
without conversations has no trie, not even a root. Other columns are not looked at.
Remainders of negative ids are those of SQL (-7 % 20 is -7).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from hookloom.llm.common import split_words, whole_text
from hookloom.session import stage_table

# Conversations come in families; a member borrows its first turns from the family's first.
FAMILY = 20
MAX_BORROWED = 4
# Turns of a conversation whose hashes one window combines.
BLOCK = 4096
# Ids written into one piece of text before pieces are digested.
IDS_A_PIECE = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 1, 128-bit hash ``t1, t2`` of role and text, ``words``; no texts.

    All turns are range partitioned by conversation and order and numbered where they lie.
    A number of copies of one row beyond a partition's share is spread by a salt.
    """
    role, text = whole_text(F.col("`role`")), whole_text(F.col("`text`"))
    turns = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.size(split_words(text)).cast("long").alias("words"),
        (F.monotonically_increasing_id() % 4096).alias("salt"),
    ).filter("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "t1", "salt"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the row's place in it below.
    placed = stage_table(
        dealt.select("conv_id", "t1", "t2", "words", F.monotonically_increasing_id().alias("place")), "trie-turns"
    ).withColumn("part", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1))
    # One row per partition.
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = placed.join(F.broadcast(offsets), "part").select(
        "conv_id", "t1", "t2", "words", (F.col("at") + F.col("offset")).alias("row")
    )
    first = placed.groupBy("conv_id").agg(F.min("row").alias("first"))
    # A conversation with very many turns is a skewed key, which adaptive execution splits.
    return placed.join(first, "conv_id").select(
        "conv_id", (F.col("row") - F.col("first") + 1).alias("pos"), "t1", "t2", "words"
    )


def family_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from their family's first turns and their own later ones.

    Conversation c takes the first h turns of conversation c - c % 20 and its own turns
    after its first h, with h = crc32 of c's decimal form modulo 4. Returns the turns as
    ``conv_id, depth, total, t1, t2, words`` and the conversations with their ``total`` turns.
    """
    turns = stage_table(turns, "trie-numbered")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    sizes = sizes.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_BORROWED,
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY,
    })
    base_sizes = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stage_table(
        sizes.join(base_sizes, "base", "left").select(
            "conv_id", "h", "base", head.alias("head"),
            (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        ),
        "trie-conversations",
    )
    own = turns.filter(F.col("pos") > 0).join(convs, "conv_id").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "total", "t1", "t2", "words"
    )
    # At most three turns a family meet its at most twenty members.
    lent = turns.filter(F.col("pos") < MAX_BORROWED).withColumnsRenamed({"conv_id": "base", "pos": "depth"})
    borrowed = convs.filter("head > 0").select("conv_id", "base", "head", "total").join(lent, "base").filter(
        F.col("depth") <= F.col("head")
    )
    return own.unionByName(borrowed.select(*own.columns)), convs.select("conv_id", "total")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per conversation and depth: hashes of the prefix and of its parent, ``words`` of the last turn.

    A prefix is a set of (place, turn) pairs, so the exclusive-or of their hashes names it.
    """
    keyed = turns.select(
        "conv_id", "depth", "total", "words", F.floor((F.col("depth") - 1) / block).alias("block"),
        F.xxhash64("depth", "t1", "t2").alias("v1"), F.xxhash64("t2", "t1", "depth", F.lit(1)).alias("v2"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = keyed.withColumns({f"k{i}": F.bit_xor(f"v{i}").over(upto) for i in (1, 2)})
    # Only conversations of several blocks have anything to carry over.
    long_ones = keyed.filter(F.col("total") > block).groupBy("conv_id", "block").agg(
        F.bit_xor("v1").alias("b1"), F.bit_xor("v2").alias("b2")
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long_ones.select("conv_id", "block", *(F.bit_xor(f"b{i}").over(before).alias(f"c{i}") for i in (1, 2)))
    joined = within.join(carried.filter("block > 0"), ["conv_id", "block"], "left")
    node = {f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)}
    return joined.withColumns(node).select(
        "conv_id", "depth", "words", "k1", "k2", (F.col("depth") == F.col("total")).alias("last"),
        *(F.col(f"k{i}").bitwiseXOR(F.col(f"v{i}")).alias(f"p{i}") for i in (1, 2)),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a partition, written together; rows come sorted by node and id."""
    node, first, ids = None, None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"k1": node[0], "k2": node[1], "depth": node[2], "first": first, "piece": ",".join(map(str, ids))}],
            schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()),
                              ("piece", pa.string())]),
        )

    for batch in batches:
        for *key, conv_id in zip(*(batch.column(name).to_pylist() for name in ("k1", "k2", "depth", "conv_id"))):
            if key != node or len(ids) >= IDS_A_PIECE:
                if ids:
                    yield piece()
                node, first, ids = key, conv_id, []
            ids.append(conv_id)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node over its pieces, which come sorted by node and first id; one piece in memory."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"k1": node[0], "k2": node[1], "depth": node[2], "ends_sha256": digest.hexdigest()}],
            schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()),
                              ("ends_sha256", pa.string())]),
        )

    for batch in batches:
        for *key, piece in zip(*(batch.column(name).to_pylist() for name in ("k1", "k2", "depth", "piece"))):
            if key != node:
                if node is not None:
                    yield row()
                node, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(f",{piece}".encode())
    if node is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` per node over the ascending ids of the conversations that end there.

    Ids are range partitioned and written into pieces, so a node with very many ends costs
    the task that digests it one row per 4,096 ids.
    """
    order = ["k1", "k2", "depth", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "k1 long, k2 long, depth long, first long, piece string"
    )
    node = ["k1", "k2", "depth"]
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(
        _digests, "k1 long, k2 long, depth long, ends_sha256 string"
    )


def subtree_totals(tree: DataFrame, totals: tuple[str, ...]) -> DataFrame:
    """Sums of the columns ``totals`` over the subtree of every node, the node included.

    ``tree`` has a row per node: ``c, d`` (its name; d grows away from the root), ``pc, pd``
    (its parent's, null at a root), ``k`` (children) and the columns. Returns ``c, d`` and sums.

    Each round rakes leaves and then takes a node out of a chain when it and its parent
    have one child each and a bit of their depths differs, so no two neighbours go at once:
    along a chain of consecutive depths every round takes out half. A node taken out is
    written down with what it had gathered and its child; as its total is that plus its
    child's total, the rounds are undone last to first.
    """
    live = stage_table(tree.select("c", "d", "pc", "pd", "k", *totals), "trie-live")
    known: list[DataFrame] = []
    taken: list[tuple[int, DataFrame]] = []
    rounds = 0
    while not live.isEmpty():
        known.append(live.filter("k = 0").select("c", "d", *totals))
        rest = live.filter("k > 0")
        leaf = F.col("k") == 0
        raked = live.filter("pc IS NOT NULL").groupBy("pc", "pd").agg(
            F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.struct("c", "d"))).alias("only"),
            *(F.sum(F.when(leaf, F.col(name)).otherwise(0)).alias(f"{name}_up") for name in totals),
        ).withColumnsRenamed({"pc": "c", "pd": "d"})
        rest = stage_table(
            rest.join(raked, ["c", "d"]).select(
                "c", "d", "pc", "pd", F.col("left").alias("k"), F.when(F.col("left") == 1, F.col("only")).alias("only"),
                *((F.col(name) + F.col(f"{name}_up")).alias(name) for name in totals),
            ),
            "trie-raked",
        )
        bit = F.shiftright("d", rounds % 62).bitwiseAND(1)
        unary = rest.filter("k = 1")
        upper = unary.filter(bit == 0).select(
            F.col("only.c").alias("c"), F.col("only.d").alias("d"), F.col("c").alias("uc"), F.col("d").alias("ud")
        )
        spliced = stage_table(
            unary.filter(bit == 1).join(upper, ["c", "d"]).select("c", "d", "uc", "ud", "only", *totals), "trie-spliced"
        )
        if spliced.isEmpty():
            live = rest.drop("only")
        else:
            taken.append((len(known), spliced))
            none = F.lit(None).cast("long")
            zero = [F.lit(0).cast("long").alias(name) for name in totals]
            changes = spliced.select("c", "d", F.lit(True).alias("gone"), none.alias("nc"), none.alias("nd"), *zero).union(
                spliced.select("uc", "ud", F.lit(False), none, none, *totals)
            ).union(spliced.select("only.c", "only.d", F.lit(False), "uc", "ud", *zero))
            changes = changes.groupBy("c", "d").agg(
                F.max("gone").alias("gone"), F.max("nc").alias("nc"), F.max("nd").alias("nd"),
                *(F.sum(name).alias(f"{name}_up") for name in totals),
            )
            live = rest.drop("only").join(changes, ["c", "d"], "left").filter("gone IS NULL OR NOT gone").select(
                "c", "d", F.coalesce("nc", "pc").alias("pc"), F.coalesce("nd", "pd").alias("pd"), "k",
                *((F.col(name) + F.coalesce(f"{name}_up", F.lit(0))).alias(name) for name in totals),
            )
            live = stage_table(live, "trie-live")
        rounds += 1
    if not known:
        return live.select("c", "d", *totals)
    # What was live after a round is known before the round's own nodes are put back.
    back: list[DataFrame] = []
    for at, spliced in reversed(taken):
        later = known[at]
        for more in [*known[at + 1:], *back]:
            later = later.union(more)
        below = later.select(
            F.col("c").alias("wc"), F.col("d").alias("wd"), *(F.col(name).alias(f"{name}_below") for name in totals)
        )
        node = spliced.withColumn("wc", F.col("only.c")).withColumn("wd", F.col("only.d"))
        back.append(stage_table(
            node.join(below, ["wc", "wd"]).select(
                "c", "d", *((F.col(name) + F.col(f"{name}_below")).alias(name) for name in totals)
            ),
            "trie-restored",
        ))
    whole = known[0]
    for more in [*known[1:], *back]:
        whole = whole.union(more)
    return whole


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations given as ``conv_id, depth, total, t1, t2, words`` a turn.

    ``convs`` names all conversations with their ``total`` turns; one without turns ends at
    the root. A row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (words that sharing the subtree's prefixes saves) and
    ``ends_sha256``.
    """
    convs = stage_table(convs, "trie-members")
    paths = stage_table(prefixes(turns, block), "trie-paths")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("c")).filter("n_convs > 0")
    grown = paths.groupBy("k1", "k2", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("c"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = stage_table(grown.withColumnRenamed("depth", "d").unionByName(
        root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("d"), "n_convs", "c", zero.alias("words"),
                    zero.alias("p1"), zero.alias("p2"))
    ), "trie-nodes")
    smallest = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    parents = nodes.filter("d > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("c").alias("pc")
    )
    # Children of the root need no lookup. Those of another wide node are a skewed side of a
    # join with unique keys, which adaptive execution splits.
    deep = nodes.filter("d > 1").join(parents, ["p1", "p2", "d"])
    flat = nodes.filter("d <= 1").withColumn("pc", F.when(F.col("d") == 1, smallest))
    tree = stage_table(deep.unionByName(flat).select(
        "c", "d", "pc", F.when(F.col("d") > 0, F.col("d") - 1).alias("pd"), "n_convs", "words", "k1", "k2"
    ), "trie-tree")
    children = tree.filter("d > 0").groupBy("pc", "pd").agg(F.count("*").alias("n_children")).select(
        F.col("pc").alias("c"), F.col("pd").alias("d"), "n_children"
    )
    ends = paths.filter("last").select("k1", "k2", "depth", "conv_id").union(
        convs.filter("total = 0").select(zero, zero, zero, "conv_id")
    )
    ends = end_digests(ends).withColumnRenamed("depth", "d")
    tree = stage_table(
        tree.join(children, ["c", "d"], "left").join(ends, ["k1", "k2", "d"], "left").select(
            "c", "d", "pc", "pd", "n_convs", F.coalesce("n_children", zero).alias("k"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
        ),
        "trie-weighed",
    )
    sums = subtree_totals(tree, ("n_leaves", "saved_tokens"))
    return tree.drop("n_leaves", "saved_tokens").join(sums, ["c", "d"]).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs",
        F.col("k").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256",
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node."""
    turns, convs = family_turns(numbered_turns(conversations))
    return prefix_trie(turns, convs)


# CRC-32 bit by bit over the digits of an id; a bigint stands for the unsigned word.
_CRC_STEP = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, "
    "list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), "
    f"lambda x, i: {_CRC_STEP})))"
)
OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {MAX_BORROWED} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, (SELECT count(*) FROM turns b WHERE b.conv_id = c.base)), t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
  SELECT conv_id, depth, len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             '[\\x20\\x09-\\x0D]+')) AS words,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank,
         string_agg(sha256(sha256(role) || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
         lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, true, '', NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = convs.conv_id) FROM convs
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN blank THEN 0 ELSE words END) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM paths GROUP BY prefix, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[:64 * n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:64 * (n.depth - 1)]
), totals AS (
  SELECT a.prefix, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM linked b JOIN paths a ON a.conv_id = b.conv_id AND a.depth <= b.depth
  GROUP BY a.prefix, a.depth
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, l.n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN totals t ON t.prefix = l.prefix AND t.depth = l.depth
"""

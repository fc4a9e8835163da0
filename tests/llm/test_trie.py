import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from hookloom.llm import trie
from tests.llm.edges import rows_of

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 long, c long, `a.b` string"
EXTRA = ("x", 1, 2, "y")


def brute_trie(rows):
    """Nodes of rows ``(conv_id, turn, role, text)``, turns of a conversation distinct."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    own.pop(None, None)
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 4
        path = own.get(conv - int(math.fmod(conv, 20)), [])[:h] + own[conv][h:]
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(conv)
        ends[tuple(path)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    return sorted(
        ((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
          hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)


def drawn(seed, convs, longest=9):
    draw, rows = random.Random(seed), []
    for conv in convs:
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, turn, draw.choice(["user", "assistant"]), draw.choice(["a b", "c", "d  e\tf", "", "g h"])))
    return rows


def test_trie_matches_brute_force(spark):
    rows = drawn(1, [*range(60), 400, 401, 1000, -3, -40]) + [(410 + i, 0, "user", "same") for i in range(40)]
    # Null turns, roles and texts, a conversation without a base and one that is left turnless.
    rows += [(70, None, None, None), (70, 0, "user", None), (70, 5, None, "t"), (505, 1, "user", "a"), (507, 1, "user", "a")]
    assert rows_of(trie.trie_report(table(spark, rows))) == brute_trie(rows)


def test_ids_are_left_out_when_null_and_empty_tables_have_no_trie(spark):
    rows = drawn(2, range(5))
    with_null = table(spark, [*rows, (None, 0, "user", "a")])
    assert rows_of(trie.trie_report(with_null)) == brute_trie(rows)
    empty = trie.trie_report(table(spark, rows).limit(0))
    assert empty.count() == 0
    assert [f.dataType.simpleString() for f in empty.schema] == ["bigint"] * 7 + ["string"]


def test_equal_turns_have_a_fixed_order(spark):
    rows = [(20, 0, "user", "b"), (20, 0, "user", "a"), (20, 0, "user", "a"), (40, 0, "user", "c")]
    first = rows_of(trie.trie_report(table(spark, rows)))
    assert first == rows_of(trie.trie_report(table(spark, rows[::-1]).repartition(2)))
    assert max(row[1] for row in first) >= 3


def test_long_chains_with_side_branches_contract(spark):
    """A conversation of many blocks, others leaving it along the way, one text very long."""
    long = [(0, t, "user", f"turn {t % 7}") for t in range(700)]
    rows = list(long)
    for conv, upto in ((20, 650), (40, 333), (60, 334), (80, 10)):
        rows += [(conv, t, "user", f"turn {t % 7}") for t in range(upto)] + [(conv, 5000, "user", "word " * 50_000)]
    turns, convs = trie.family_turns(trie.numbered_turns(table(spark, rows)))
    assert rows_of(trie.prefix_trie(turns, convs, block=16)) == brute_trie(rows)


def test_contraction_of_random_trees(spark):
    for seed in range(1):
        draw = random.Random(seed)
        # Mostly chains, with some branches.
        parent = {0: None}
        for node in range(1, 200):
            parent[node] = node - 1 if draw.random() < 0.9 else draw.randrange(node)
        depth, below = {0: 0}, {n: n * n for n in parent}
        for node in range(1, 200):
            depth[node] = depth[parent[node]] + 1
        for node in range(199, 0, -1):
            below[parent[node]] += below[node]
        kids = defaultdict(int)
        for node, up in parent.items():
            kids[up] += 1
        rows = [(n, depth[n], p, None if p is None else depth[p], kids[n], n * n) for n, p in parent.items()]
        tree = spark.createDataFrame(rows, "c long, d long, pc long, pd long, k long, w long")
        got = {r.c: r.w for r in trie.subtree_totals(tree, ("w",)).collect()}
        assert got == below


def test_digests_of_a_node_with_many_ends(spark):
    ids = random.Random(3).sample(range(10**6), 10_000)
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(0, 2, 3, 7)], "k1 long, k2 long, depth long, conv_id long")
    got = {r.k1: r.ends_sha256 for r in trie.end_digests(ends.repartition(7)).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(),
                   0: hashlib.sha256(b"7").hexdigest()}


def test_prefix_hashes_do_not_depend_on_the_block(spark):
    rows = drawn(4, range(0, 200, 20), 40)
    turns, _ = trie.family_turns(trie.numbered_turns(table(spark, rows)))
    keys = [rows_of(trie.prefixes(turns, block).select("conv_id", "depth", "k1", "k2", "p1")) for block in (1, 7, 4096)]
    assert keys[0] == keys[1] == keys[2]
    assert trie.prefixes(turns).filter(F.col("last")).count() == 10

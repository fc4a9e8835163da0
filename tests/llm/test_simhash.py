import random
import re
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from hookloom.llm import simhash
from hookloom.llm.components import connected_components
from tests.llm.edges import documents, no_documents, prose, rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if bin(a ^ b).count("1") <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_and_components_match_brute_force(spark):
    texts = ["One", "one two", "ONE two three É", *(prose(i, 30) for i in range(20)), prose(3, 30) + "  ", prose(4, 30) + " x"]
    docs = documents(spark, *texts)
    source = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    roots = brute_roots({fp for _, fp in source})
    first = {}
    for doc_id, fp in source:
        if doc_id is not None:
            first[roots[fp]] = min(first.get(roots[fp], doc_id), doc_id)
    want = sorted(((d, f"{fp:016x}", first.get(roots[fp])) for d, fp in source), key=repr)
    assert rows_of(simhash.simhash_report(docs)) == want


def test_links_join_the_same_groups_for_small_and_large_buckets(spark):
    draw = random.Random(4)
    prints = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            at ^= 1 << draw.randrange(64)
            if draw.random() < 0.4:
                at ^= 1 << draw.randrange(64)
    want = brute_roots(prints)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for paired in (2, 10_000):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.close_links(table, 2, paired)).collect()}
        got, groups = {}, {}
        for p in prints:
            got.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
            groups.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_distance_one(spark):
    base = 0x1234_5678_9ABC_DEF0
    prints = [base, base ^ 1, base ^ 1 ^ 1 << 40, base ^ 6 ^ 1 << 50]
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for paired in (1, 100):
        links = {tuple(sorted(r)) for r in simhash.close_links(table, 1, paired).collect()}
        assert links == {(base, base ^ 1), tuple(sorted((base ^ 1, base ^ 1 ^ 1 << 40)))}


def test_long_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)] + [(7, 7), (1000, 1001), (1001, 1000)]
    table = spark.createDataFrame(chain, "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(table).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 303
    assert connected_components(table.filter("a < 0")).collect() == []


def test_one_of_each_group_stays(spark):
    docs = documents(spark, prose(1, 40), prose(1, 40), prose(1, 40).upper(), prose(2, 40))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i and i < 900) == [1, 4]
    # Empty texts are one group, whose smallest id stays; equal ids of other texts both stay.
    assert ids.count(901) == 1 and 902 not in ids and ids.count(904) == 2 and ids.count(None) == 1


def test_nested_columns_are_carried(spark):
    docs = documents(spark, prose(1, 40), prose(1, 40), prose(2, 40)).withColumn(
        "fp", F.struct(F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.parse_json(F.lit("[1]")).alias("v"))
    )
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] and r["doc_id"] < 900) == [1, 3]


def test_empty_table(spark):
    assert simhash.simhash_report(no_documents(spark)).collect() == []
    assert simhash.drop_near_duplicates(no_documents(spark)).collect() == []


def test_engine_hash_is_the_contracts(spark):
    got = spark.createDataFrame([("héllo wörld",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("héllo wörld".encode(), 42)

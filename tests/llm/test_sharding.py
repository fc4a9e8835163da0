import zlib

import numpy as np
import pytest

from hookloom.llm import sharding
from tests.llm.edges import documents, no_documents, prose, rows_of


def test_report_is_balanced_and_gapless(spark):
    docs = documents(spark, *(prose(i, 20 + i % 50) for i in range(150)), *["copy " * 30] * 120)
    source = docs.collect()
    got = sharding.sharding_report(docs, shards=4).collect()
    assert len(got) == len(source)
    expected = sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source), key=repr
    )
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == expected
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    # The long text alone is larger than the other shards may get.
    sizes = sorted(sum(r["size"] for r in got if r["shard"] == s) for s in range(4))
    assert sizes[2] - sizes[0] <= 0.02 * sizes[2]


def shards_by_text(got):
    places = {}
    for row in got:
        places.setdefault(row["text_crc32"], set()).add(row["shard"])
    return places


@pytest.mark.parametrize("units", [1, 8, 512])
def test_only_groups_beyond_a_shards_share_are_cut(spark, units):
    """Whatever the number of units: 40 texts thrice, and one text with most of the rows."""
    texts = [prose(i % 40, 30) for i in range(120)]
    docs = documents(spark, *texts).filter("doc_id <> 905")
    got = sharding.assign_shards(docs, ["doc_id"], shards=4, units_per_shard=units).collect()
    assert all(len(places) == 1 for places in shards_by_text(got).values())
    most = documents(spark, *texts, *["one text of many rows " * 10] * 400).filter("doc_id <> 905")
    got = sharding.assign_shards(most, ["doc_id"], shards=4, units_per_shard=units).collect()
    large = zlib.crc32(("one text of many rows " * 10).encode())
    places = shards_by_text(got)
    assert len(places.pop(large)) == (4 if units > 1 else len(shards_by_text(got)[large]))
    assert all(len(shards) == 1 for shards in places.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_of_the_tables_stay_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sharding.sharding_report(docs).collect()
    places = shards_by_text(got)
    rows = [r["text_crc32"] for r in got]
    assert sum(rows.count(text) > 1 for text in places) > 3
    assert all(len(shards) == 1 for shards in places.values())
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) <= 1.01 * min(sizes) or sf == "sf0.001"


def test_shards_do_not_depend_on_partitions(spark):
    # One text beyond a shard's share, some of its rows equal in all columns.
    ids = [*range(100), *[7] * 50, *[None] * 60]
    docs = spark.createDataFrame([(i, "a text of many rows") for i in ids] + [(i, prose(i, 10)) for i in range(200, 300)], "doc_id long, text string")
    runs = [
        sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in sharding.sharding_report(docs.repartition(n), shards=4).collect())
        for n in (3, 7)
    ]
    assert runs[0] == runs[1] and len({shard for _, _, shard in runs[0]}) == 4


def test_pack_and_level():
    draw = np.random.default_rng(3)
    vectors = np.stack([draw.lognormal(8, 1, 500), draw.lognormal(6, 1, 500), np.ones(500)], axis=1)
    chosen = sharding.level(vectors, sharding.pack(vectors, 8), 8)
    loads = np.stack([np.bincount(chosen, weights=vectors[:, d], minlength=8) for d in range(3)])
    spread = (loads.max(axis=1) - loads.min(axis=1)) / loads.mean(axis=1)
    assert spread[0] < 0.001 and spread[1] < 0.1 and spread[2] < 0.05
    # Units by size: 0, then 2, which only fits the other shard, then 1, which fits neither.
    assert sharding.pack(np.array([[4.0, 1.0], [3.0, 3.0], [1.0, 4.0]]), 2).tolist() == [0, 0, 1]


def test_ranges_number_large_units(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    got = sharding.sharding_report(documents(spark, *(prose(i, 10) for i in range(40))), shards=3).collect()
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_documents_keep_their_columns(spark):
    docs = documents(spark, prose(1, 10))
    got = sharding.shard_documents(docs, shards=3)
    assert got.columns[:len(docs.columns)] == docs.columns
    assert rows_of(got.select(*(f"`{c}`" for c in docs.columns))) == rows_of(docs)


def test_empty_table(spark):
    assert sharding.sharding_report(no_documents(spark)).collect() == []

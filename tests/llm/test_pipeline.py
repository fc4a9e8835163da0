import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edges import documents, no_documents, prose, rows_of

PASSAGE = "one question that a benchmark asks about rivers and stones and seven lights under glass tonight"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with clean texts, poor ones, exact and near copies, contaminated texts and toxic ones."""
    path = str(tmp_path_factory.mktemp("sf"))
    clean = [prose(i, 60 + i % 40) for i in range(260)]
    poor = [" ".join(w + "%%%" for w in prose(3000 + i, 80).split()) for i in range(12)]
    copies = [clean[0]] * 30 + [clean[1] + " end"] * 5 + [clean[2]] * 2
    dirty = [f"{prose(5000 + i, 20)} {PASSAGE} {prose(6000 + i, 20)}" for i in range(6)]
    toxic = []
    for i in range(60):
        words = prose(7000 + i, 60).split()
        words[::7] = ["scum"] * len(words[::7])
        toxic.append(" ".join(words))
    texts = [*clean, *poor, *copies, *dirty, *toxic]
    documents(spark, *texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q1", PASSAGE), ("q2", None), (None, "x")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    first_toxic = len(texts) - len(toxic) + 1
    marks = [(i, 1, 0) for i in range(1, 120)] + [(i, 1, 1) for i in range(first_toxic, first_toxic + 40)] + [(None, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {name: set(part) for name, part in dict(clean=clean, poor=poor, dirty=dirty, toxic=toxic).items()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_each_stage_acts_and_hands_on_whole_rows(spark, folder):
    path, kinds = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert set(rows_of(docs)) <= set(before)
        seen[name] = docs.select(*(f"`{c}`" for c in columns)).collect()
        docs = spark.createDataFrame(seen[name], spark.read.parquet(f"{path}/documents.parquet").schema) if name != "sharding" else docs
    texts = {name: [r["text"] for r in rows] for name, rows in seen.items()}
    assert all(len(words_of(t)) >= 20 for t in texts["quality"])
    assert not kinds["poor"] & set(texts["quality"]) and kinds["clean"] <= set(texts["quality"])
    # One of each group of near copies, by the operator's own fingerprints; the first ids stay.
    assert len(texts["near_dedup"]) == len(set(texts["near_dedup"]))
    assert kinds["clean"] - {prose(1, 61)} <= set(texts["near_dedup"]) | {prose(1, 61)}
    assert not kinds["dirty"] & set(texts["decontamination"])
    assert set(texts["near_dedup"]) - set(texts["decontamination"]) == kinds["dirty"] & set(texts["near_dedup"])
    # Toxic texts are thinned out, clean ones are not.
    toxic = [t for t in texts["mixing"] if t in kinds["toxic"]]
    assert len(toxic) < 0.6 * len(kinds["toxic"])
    assert len(kinds["clean"] & set(texts["mixing"])) > 0.9 * len(kinds["clean"])
    assert sorted(texts["sharding"]) == sorted(texts["mixing"])


def test_run_gives_gapless_shards(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len(rows) > 200


def test_empty_tables_and_nulls_alone(spark, folder):
    path = folder[0]
    nulls = documents(spark).filter("text IS NULL OR doc_id IS NULL OR trim(text) = ''")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents(spark), path).count() == 0
        kept = stage(spark, nulls, path).count()
        assert (name in ("near_dedup", "quality", "mixing")) or kept == nulls.count()
    assert corpus_pipeline.STAGES[0][1](spark, nulls, path).filter(F.col("text").isNull()).count() == 0
